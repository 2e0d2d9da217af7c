"""Blocks of whole texts as flat numpy arrays: words, word hashes, shingles.

The helpers run inside tasks. A block joins the UTF-8 bytes of some texts, each
followed by one newline, so one numpy pass serves many short texts; a very long
text is a block of its own and is worked on in windows cut at white space.
White space is ``[\\x20\\x09-\\x0D]``, words are what lies between, and A-Z are
lower-cased before hashing. Hashes depend on bytes alone, never on the process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21
BLOCK_TEXTS = 1 << 15
_WINDOW = 1 << 18
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _FACTOR)[LOWER]
_INVERSE = pow(int(_FACTOR), -1, 1 << 64)
_POW, _INV = _powers(int(_FACTOR), _WINDOW), _powers(_INVERSE, _WINDOW)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


PREFIX = 6


def _word_window(w: np.ndarray) -> tuple[np.ndarray, ...]:
    edge = np.diff((~SPACE[w]).view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(w) <= _WINDOW:
        power, inverse = _POW[: len(w)], _INV
    else:  # one word longer than a window
        power, inverse = _powers(int(_FACTOR), len(w)), _powers(_INVERSE, len(w))
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(_BYTE[w] * power, out=total[1:])
    cut = np.minimum(end, start + PREFIX)
    whole, head = ((total[x] - total[start]) * inverse[start] ^ ((x - start).astype(np.uint64) * _STEP) for x in (end, cut))
    return start, end, mix(whole), mix(head)


def words(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, hash, hash of the first PREFIX bytes) of every word of
    ``data``, in order."""
    parts, at, n = [], 0, len(data)
    while at < n:
        to = min(at + _WINDOW, n)
        if to < n:
            gaps = np.flatnonzero(SPACE[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < n and not SPACE[data[to]]:
                    more = np.flatnonzero(SPACE[data[to : to + _WINDOW]])
                    to = to + int(more[0]) if len(more) else min(to + _WINDOW, n)
        start, end, h, head = _word_window(data[at:to])
        parts.append((start + at, end + at, h, head))
        at = to
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@dataclass
class Block:
    """``first`` and ``last`` bound each text in ``data``; ``word_at[i]`` to
    ``word_at[i + 1]`` are the words of text i."""

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray
    heads: np.ndarray
    word_at: np.ndarray

    def __len__(self) -> int:
        return len(self.first)


def block(texts: list[bytes]) -> Block:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.cumsum(sizes + 1) - 1
    start, end, h, heads = words(data)
    word_at = np.concatenate([[0], np.searchsorted(start, last)])
    return Block(data, last - sizes, last, start, end, h, heads, word_at)


def blocks(column: pa.Array | pa.ChunkedArray) -> Iterator[Block]:
    """Blocks of a column of texts, of about BLOCK_BYTES and at most BLOCK_TEXTS
    texts each, in row order."""
    part, size = [], 0
    for text in text_bytes(column):
        if part and (size + len(text) > BLOCK_BYTES or len(part) == BLOCK_TEXTS):
            yield block(part)
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield block(part)


def sequence_hash(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position ``at``."""
    total, power = np.full(len(at), n, np.uint64), 1
    for k in range(n):
        power = power * int(_STEP) % (1 << 64)
        total = total + h[at + k] * np.uint64(power)
    return mix(total)


def shingle_hashes(b: Block, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has ``hashes[bounds[i]:bounds[i + 1]]``, in text
    order. A text of fewer than ``size`` words has its whole sequence as one
    shingle; one without words has none."""
    n_words = np.diff(b.word_at)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(bounds[-1], np.uint64)
    full = np.repeat(n_words >= size, n)
    at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(b.word_at[:-1], n)
    out[full] = sequence_hash(b.hashes, at[full], size)
    for k in range(1, size):
        short = np.flatnonzero(n_words == k)
        out[bounds[short]] = sequence_hash(b.hashes, b.word_at[short], k)
    return out, bounds


def shingle_sets(b: Block, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, bounds = shingle_hashes(b, size)
    return [np.unique(hashes[i:j]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]


def segment_counts(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of true flags in each ``flags[at[i]:at[i + 1]]``."""
    return np.diff(np.searchsorted(np.flatnonzero(flags), at))


def distinct_counts(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of distinct hashes in each segment, told apart by 48 bits."""
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
    keys = np.sort(owner << np.uint64(48) | hashes >> np.uint64(16))
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return segment_counts(new, at)


def word_hash(word: str) -> int:
    return int(block([word.encode()]).hashes[0])
