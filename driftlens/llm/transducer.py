"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary with word ends is compiled, transition by transition as
texts need them, into a deterministic transducer over bytes (each byte has a
second symbol for "last byte of a word"). Its state knows, for every place where
a token under way may have begun, the part of that token read so far, the token
before it and how many tokens lie before it. Reading a byte settles the one token
that ends there: a sequence of tokens is what the merges give exactly when each
two neighbours are what the merges give for the two alone, so only one token can.
Each transition is annotated with the change of the token count.

A block of texts is cut into equal chunks whatever the words. All chunks are run
side by side from the unknown state, which a word end resets; that yields each
chunk's state map: what its head, up to the first word end, adds from the state
that comes in, and the constant state and count after it. A prefix scan over the
maps finds the state that comes into each chunk, and the heads are run from it.

Null and empty texts have no tokens.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_MODEL = "word_bpe_49k.json"
LIMIT = 2048
CHUNK = 192
BLOCK_CHARS = 1 << 20
MAX_STATES = 200_000
MAX_FITS = 250_000
_UNKNOWN, _START = 0, 1
END = 256  # symbol of a byte that ends a word: byte + END

# The endings that the word pattern splits after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: bytes that
    print stand for themselves, the others follow from code point 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordModel:
    """A byte-level BPE vocabulary with word ends: tokens are tuples of symbols."""

    def __init__(self, merges: list[tuple[tuple[int, ...], tuple[int, ...]]], special: list[str]):
        self.rank = {pair: i for i, pair in reversed(list(enumerate(merges)))}
        self.special = special
        self.tokens = list(dict.fromkeys([(s,) for s in range(2 * END)] + [a + b for a, b in merges]))

    @classmethod
    def read(cls, path: str) -> WordModel:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, suffix = byte_letters(), spec["model"]["end_of_word_suffix"]

        def symbols(token: str) -> tuple[int, ...]:
            if token.endswith(suffix):
                token = token[: -len(suffix)]
                return (*(letters[c] for c in token[:-1]), letters[token[-1]] + END)
            return tuple(letters[c] for c in token)

        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        return cls([(symbols(a), symbols(b)) for a, b in merges], [t["content"] for t in spec["added_tokens"]])

    def merged(self, parts: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
        """What the merges give: the earliest merge first, its leftmost place first."""
        while True:
            ranks = [self.rank.get(p, sys.maxsize) for p in zip(parts, parts[1:])]
            best = min(ranks, default=sys.maxsize)
            if best == sys.maxsize:
                return parts
            i = ranks.index(best)
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]

    def stays(self, left: int, right: int) -> bool:
        """The merges leave these two tokens as they are; a left of -1 is none."""
        pair = [self.tokens[t] for t in (left, right) if t >= 0]
        return self.merged([(s,) for t in pair for s in t]) == pair


class _Table:
    """Compiled transitions by (state, symbol), in arrays with open addressing:
    states use few of the symbols, so a full grid would be nearly empty."""

    def __init__(self, bits: int = 16):
        self.bits, self.used = bits, 0
        self.keys = np.full(1 << bits, -1, np.int64)
        self.next, self.token = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
        self.change = np.zeros(1 << bits, np.int8)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 where there is none."""
        slot = self._first(keys)
        there = self.keys[slot]
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        slot[there < 0] = -1
        while len(open_):
            probe = (slot[open_] + 1) & ((1 << self.bits) - 1)
            there = self.keys[probe]
            slot[open_] = np.where(there < 0, -1, probe)
            open_ = open_[(there != keys[open_]) & (there >= 0)]
        return slot

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Puts new, distinct keys with rows (next, change, token)."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            old, full = self, np.flatnonzero(self.keys >= 0)
            grown = _Table(max(self.bits + 1, int(2 * (self.used + len(keys))).bit_length()))
            grown.add(old.keys[full], np.stack([old.next[full], old.change[full], old.token[full]], axis=1))
            self.__dict__ = grown.__dict__
        self.used += len(keys)
        slot, wait = self._first(keys), np.arange(len(keys))
        while len(wait):
            at = slot[wait]
            free = np.flatnonzero(self.keys[at] < 0)
            _, one = np.unique(at[free], return_index=True)
            placed = free[one]
            rows = wait[placed]
            self.keys[slot[rows]] = keys[rows]
            self.next[slot[rows]], self.change[slot[rows]], self.token[slot[rows]] = values[rows].T
            wait = np.delete(wait, placed)
            slot[wait] = (slot[wait] + 1) & ((1 << self.bits) - 1)


_NODE, _ZERO = (1 << 22) - 1, 1 << 12


def _packed(node: int, left: int, count: int) -> int:
    """One entry of a state as a number: there are very many states."""
    return count + _ZERO << 44 | left + 1 << 22 | node


class Transducer:
    """Transitions (next state, change of the count, token that ends here),
    compiled when first met. A state lists, for each place where a token under
    way began, (node of the part read, token before, tokens before)."""

    def __init__(self, model, max_states: int = MAX_STATES):
        self.model, self.max_states = model, max_states
        self._fits: dict[int, bool] = {}
        # a trie of the tokens: node << 10 | symbol -> node
        self._child: dict[int, int] = {}
        self._token: dict[int, int] = {}
        self._inner: set[int] = set()
        for number, symbols in enumerate(model.tokens):
            node = 0
            for s in symbols:
                self._inner.add(node)
                node = self._child.setdefault(node << 10 | s, len(self._child) + 1)
            self._token[node] = number
        self._clear()

    def _clear(self) -> None:
        self._number: dict[tuple, int] = {}
        self._states: list[tuple] = [(), (_packed(0, -1, 0),)]  # unknown; start of a word
        self._number[self._states[_START]] = _START
        self.table = _Table()

    def _compile(self, state: int, symbol: int) -> tuple[int, int, int]:
        if state == _UNKNOWN:
            return (_START if symbol >= END else _UNKNOWN), 0, -1
        token, before, kept = -1, 0, []
        for entry in self._states[state]:
            node = self._child.get((entry & _NODE) << 10 | symbol)
            if node is None:
                continue
            left, count = (entry >> 22 & _NODE) - 1, (entry >> 44) - _ZERO
            ended = self._token.get(node, -1)
            if token < 0 <= ended:
                key = left << 32 | ended
                good = self._fits.get(key)
                if good is None:
                    if len(self._fits) > MAX_FITS:
                        self._fits.clear()
                    good = self._fits[key] = self.model.stays(left, ended)
                if good:
                    token, before = ended, count
            if node in self._inner:
                kept.append((node, left, count))
        total = before + 1 if token >= 0 else 0
        if symbol >= END:
            return _START, total, token
        content = [_packed(node, left, count - total) for node, left, count in kept]
        if token >= 0:
            content.append(_packed(0, token, 0))
        content = tuple(content)
        number = self._number.get(content)
        if number is None:
            number = self._number[content] = len(self._states)
            self._states.append(content)
        return number, total, token

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Slots of the transitions from each state by its symbol."""
        keys = states.astype(np.int64) << 10 | symbols
        slot = self.table.find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new = np.unique(keys[missing])
            self.table.add(new, np.array([self._compile(k >> 10, k & 1023) for k in new.tolist()], np.int64))
            slot = self.table.find(keys)
        return slot

    def run(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(change of the count, token that ends or -1) at each symbol of a stream
        of whole words."""
        if len(self._states) > self.max_states:
            self._clear()
        n = len(symbols)
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, END, np.int32)  # padding: one-byte words
        grid[:n] = symbols
        flat = grid
        grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
        out = np.zeros((CHUNK, chunks), np.int8)
        ends_here = np.empty((CHUNK, chunks), np.int32)
        # every chunk from the unknown state: the constant part of its map
        state = np.full(chunks, _UNKNOWN, np.int32)
        for k in range(CHUNK):
            slot = self.step(state, grid[k])
            state, out[k], ends_here[k] = self.table.next[slot], self.table.change[slot], self.table.token[slot]
        ends = grid >= END
        resets = ends.any(axis=0)
        head = np.where(resets, ends.argmax(axis=0) + 1, CHUNK)
        # scan: a chunk with a word end hands on its own last state; one without
        # joins the head of the next, so its run starts where the last reset was
        source = np.maximum.accumulate(np.where(resets, np.arange(chunks), -1))
        comes_from = np.concatenate([[-1], source[:-1]])
        first = np.flatnonzero(comes_from == np.arange(chunks) - 1)
        state_in = np.where(comes_from[first] < 0, _START, state[comes_from[first]]).astype(np.int32)
        at = first * CHUNK
        length = head[first].copy()
        for i in np.flatnonzero(~resets[first]):  # the head goes on into later chunks
            c = first[i]
            while c < chunks and not resets[c]:
                c += 1
            length[i] = (c - first[i]) * CHUNK + (head[c] if c < chunks else 0)
        changes, tokens = (np.ascontiguousarray(x.T).reshape(-1) for x in (out, ends_here))
        k = 0
        live = np.flatnonzero(length > 0)
        while len(live):
            spots = at[live] + k
            slot = self.step(state_in[live], flat[spots])
            state_in[live], changes[spots], tokens[spots] = self.table.next[slot], self.table.change[slot], self.table.token[slot]
            k += 1
            live = live[length[live] > k]
        return changes[:n], tokens[:n]


# -- words -------------------------------------------------------------------
_LETTER, _NUMBER, _GAP, _OTHER = 1, 2, 3, 0
_CLASS: list[np.ndarray] = []
_SPACES = re.compile(r"\s")


def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    if not _CLASS:
        kinds = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                kinds[c] = _LETTER
            elif kind == "N":
                kinds[c] = _NUMBER
        gaps = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
        kinds[gaps] = _GAP
        _CLASS.append(kinds)
    return _CLASS[0]


def normalized(text: str) -> str:
    """NFC, lower case letter by letter (no context)."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def word_symbols(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, code point of each symbol): the bytes of the words of a
    normalised text, white space left out, the last byte of each word marked."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = char_classes()[points]
    n = len(points)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    starts = np.ones(n, bool)
    starts[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
    quotes = np.flatnonzero((points == 0x27) & starts)
    for q in quotes.tolist():  # an apostrophe that begins a word may begin an ending
        tail = text[q + 1 : q + 3]
        for ending in ENDINGS:
            if tail.startswith(ending):
                to = q + 1 + len(ending)
                starts[q + 1 : to] = False
                if to < n:
                    starts[to] = True
                break
    last = np.ones(n, bool)
    last[:-1] = starts[1:]
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    owner = np.repeat(np.arange(n), size)
    final = np.zeros(len(raw), bool)
    final[np.cumsum(size) - 1] = last
    keep = kind[owner] != _GAP
    return raw[keep].astype(np.int32) + END * final[keep], owner[keep]


class Counter:
    """Token counts of texts."""

    def __init__(self, model: WordModel):
        self.machine = Transducer(model)
        self.special = re.compile("|".join(map(re.escape, model.special))) if model.special else None

    def counts(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        group, owners, size = [], [], 0
        for i, text in enumerate(texts):
            parts = [text]
            if self.special is not None and "<" in text:
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                group.append(normalized(part))
                owners.append(i)
                size += len(part)
            if size >= BLOCK_CHARS:
                self._add(out, group, owners)
                group, owners, size = [], [], 0
        if group:
            self._add(out, group, owners)
        return out

    def _add(self, out: np.ndarray, group: list[str], owners: list[int]) -> None:
        # a line end between two parts ends the word before it
        symbols, place = word_symbols("\n".join(group))
        if len(symbols):
            bounds = np.concatenate([[0], np.cumsum([len(g) + 1 for g in group])])
            total = np.concatenate([[0], np.cumsum(self.machine.run(symbols)[0], dtype=np.int64)])
            cut = np.searchsorted(place, bounds)
            np.add.at(out, owners, total[cut[1:]] - total[cut[:-1]])


_HELD: dict = {}


def token_count(text: str | Column, shared) -> Column:
    """Number of tokens of each text; ``shared`` comes from ``share``."""

    @F.arrow_udf("long")
    def run(column: pa.Array) -> pa.Array:
        # one transducer per worker: what it has compiled serves later tasks
        if _HELD.get("of") != shared.id:
            _HELD.update(of=shared.id, counter=Counter(shared.value["model"]))
        return pa.array(_HELD["counter"].counts([x or "" for x in column.to_pylist()]), pa.int64())

    return run(text)


class Shared:
    """The vocabulary, for the tasks; its size is fixed."""

    def __init__(self, spark: SparkSession, path: str):
        self._sent = spark.sparkContext.broadcast({"model": WordModel.read(path)})
        self.id = f"{spark.sparkContext.applicationId}:{path}"

    @property
    def value(self):
        return self._sent.value


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document row."""
    n = token_count(docs[text], Shared(docs.sparkSession, path))
    size = F.coalesce(F.octet_length(docs[text]), F.lit(0)).cast("long")
    out = docs.select("doc_id", size.alias("n_bytes"), n.alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
