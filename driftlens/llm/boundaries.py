"""A compressed set of byte positions with rank and select, after the roaring layout.

Positions are dealt into chunks of 2^16. Each chunk is kept in the smallest of three
containers: a sorted array of its low 16 bits, a bitmap of 2^16 bits, or a list of
runs. Cumulative cardinalities over the chunks find the container of the k-th member,
which then selects inside itself. All look-ups take arrays of queries.

The set built here is that of code point starts of UTF-8 bytes: plain ASCII is one
run, scripts of two or three bytes a letter are bitmaps, a short rest is an array.
"""

from __future__ import annotations

import numpy as np

CHUNK = 1 << 16
WORDS = CHUNK // 64
_BITMAP_BYTES = CHUNK // 8


class ArrayContainer:
    """Sorted low bits."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, at, side="left")

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)


class RunContainer:
    """Starts of runs and how many members lie before each."""

    def __init__(self, start: np.ndarray, length: np.ndarray):
        self.start, self.length = start.astype(np.int64), length.astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(self.length)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        i = np.maximum(np.searchsorted(self.start, at, side="right") - 1, 0)
        return self.before[i] + np.clip(at - self.start[i], 0, self.length[i])

    def select(self, k: np.ndarray) -> np.ndarray:
        i = np.searchsorted(self.before, k, side="right") - 1
        return self.start[i] + k - self.before[i]


class BitmapContainer:
    """Bits in 64-bit words and how many members lie before each word."""

    def __init__(self, flags: np.ndarray):
        bits = np.zeros(CHUNK, np.uint8)
        bits[: len(flags)] = flags
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = np.minimum(at >> 6, WORDS - 1)
        under = np.minimum(at - (word << 6), 64).astype(np.uint64)
        mask = np.where(under == 64, ~np.uint64(0), (np.uint64(1) << (under & np.uint64(63))) - np.uint64(1))
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        word = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        nth = (k - self.before[word] + 1)[:, None]
        return (word << 6) + (np.cumsum(bits, axis=1) == nth).argmax(axis=1)


def container(flags: np.ndarray) -> ArrayContainer | RunContainer | BitmapContainer:
    """The smallest container of the set positions of a chunk."""
    edge = np.diff(flags.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, members = np.flatnonzero(edge == 1), np.count_nonzero(flags)
    size = {ArrayContainer: 2 * members, RunContainer: 4 * len(start), BitmapContainer: _BITMAP_BYTES}
    kind = min(size, key=size.get)
    if kind is RunContainer:
        return RunContainer(start, np.flatnonzero(edge == -1) - start)
    return ArrayContainer(np.flatnonzero(flags)) if kind is ArrayContainer else BitmapContainer(flags)


class BoundarySet:
    """Members are the set positions of ``flags``, and its length as the last."""

    def __init__(self, flags: np.ndarray):
        ends = range(0, len(flags) + 1, CHUNK)
        chunks = [flags[at : at + CHUNK] for at in ends]
        chunks[-1] = np.concatenate([chunks[-1], [True]])
        self.containers = [container(c) for c in chunks]
        self.before = np.concatenate([[0], np.cumsum([np.count_nonzero(c) for c in chunks])])

    @classmethod
    def of_code_points(cls, data: np.ndarray) -> BoundarySet:
        """Starts of the code points of UTF-8 bytes, and their end."""
        return cls((data & 0xC0) != 0x80)

    def __len__(self) -> int:
        return int(self.before[-1])

    def _each(self, chunk: np.ndarray, local: np.ndarray, what: str) -> np.ndarray:
        out = np.zeros(len(chunk), np.int64)
        order = np.argsort(chunk, kind="stable")
        edges = np.flatnonzero(np.diff(chunk[order], prepend=-1, append=len(self.containers)))
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            rows = order[lo:hi]
            out[rows] = getattr(self.containers[chunk[rows[0]]], what)(local[rows])
        return out

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Members below each position."""
        at = np.asarray(at, np.int64)
        chunk = np.minimum(at // CHUNK, len(self.containers) - 1)
        return self.before[chunk] + self._each(chunk, at - chunk * CHUNK, "rank")

    def select(self, k: np.ndarray) -> np.ndarray:
        """The member with ``k`` members below it."""
        k = np.asarray(k, np.int64)
        chunk = np.searchsorted(self.before, k, side="right") - 1
        return chunk * CHUNK + self._each(chunk, k - self.before[chunk], "select")
