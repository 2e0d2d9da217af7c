"""SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary is a BPE model with byte fallback. A sequence of pieces is what
the model's merges give for its text exactly when every two neighbours are what
the merges give for the text of the two; so among the paths through the lattice
of pieces one and only one survives at each boundary. The walk along a text keeps
a window bounded by the longest piece: for each boundary in it, the last piece of
the surviving path. Ids are committed up to the boundary where the paths to all
of the window meet; two characters that no piece holds side by side are such a
boundary for certain.

No piece holds a space mark after another character, so the beginning of a word is such
a boundary too: texts are cut into words by Arrow, each distinct word of a batch is walked
once for all its places, and a bounded store keeps the ids of words met lately. A word of
up to ``WINDOW`` characters fits into one window, and such words are walked side by side,
a boundary of all of them at a time; a longer one goes through
``Encoder.stream``, whose window moves on as ids are committed, whatever its length. Long
texts are cut at words into parts, so memory does not grow with a text beyond its own
characters and ids.

Null and empty texts have no ids; null ids decode to an empty text. Each row is worked on
by itself, repeated ones too; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.transducer import _Table

MARK = "▁"
PIECE_MODEL = "piece_bpe_32k.model"
MAX_FITS = 50_000  # pairs that long and odd words keep
MAX_PAIRS = 400_000  # pairs that words side by side keep, in arrays
MAX_WORDS = 1 << 17  # words in each of the two generations of a worker's store
LANES = 1 << 14  # words that are walked side by side
WINDOW = 64  # characters; longer words are walked in a moving window
PART_CHARS = 1 << 21  # bytes of texts that are worked on together
_CUT = "\0"
DECODE_IDS = 1 << 18
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class Vocabulary:
    """Pieces of a model: ids, scores, byte pieces."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[str]):
        self.pieces, self.kinds = pieces, kinds
        self.ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.score = {p: scores[i] for p, i in self.ids.items()}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        self.unknown = next((i for i, k in enumerate(kinds) if k == "unknown"), 0)
        self.longest = max(map(len, self.ids), default=1)
        self.name = hashlib.sha256(repr((pieces, scores, kinds)).encode()).hexdigest()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(model.get_piece_size())

        def kind(i: int) -> str:
            for name, test in (("unknown", model.is_unknown), ("control", model.is_control), ("byte", model.is_byte), ("unused", model.is_unused)):
                if test(i):
                    return name
            return "normal"

        return cls([model.id_to_piece(i) for i in n], [model.get_score(i) for i in n], [kind(i) for i in n])


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._fits: dict[tuple[str, str], bool] = {}
        # every beginning of a piece, and whether it is one
        self._starts = {p[:k]: False for p in vocabulary.ids for k in range(1, len(p))}
        self._starts.update(dict.fromkeys(vocabulary.ids, True))
        self._number = {p: vocabulary.ids.get(p, -1) for p in self._starts}
        self._pairs: dict[int, bool] = {}
        self.lanes = _Lanes(self)
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        # a mark after another character ends no piece: words can be walked alone
        self.by_words = not any(a != MARK == b for p in vocabulary.ids for a, b in zip(p, p[1:]))

    def merged(self, text: str) -> list[str]:
        """What the model's merges give: the best pair first, the leftmost of
        equals. For texts of two pieces at most."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.v.score.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, left: str, right: str) -> bool:
        """The merges leave these two neighbours as they are."""
        out = self._fits.get((left, right))
        if out is None:
            if len(self._fits) > MAX_FITS:
                self._fits.clear()
            out = self._fits[left, right] = self.merged(left + right) == [x for x in (left, right) if x]
        return out

    def stream(self, text: str) -> Iterator[str]:
        """Pieces of a text, each as soon as it is final."""
        starts, longest, fits, seen = self._starts, self.v.longest, self.fits, self._fits
        base, end = 0, len(text)  # pieces up to base are out
        # last[k]: the piece that ends at base + k on the path there
        last: list[str | None] = [""] + [None] * (min(end, 6 * longest) + longest)
        due, i = 4 * longest, 0
        while base + i < end:
            left, at = last[i], base + i
            for to in range(at + 1, min(at + longest, end) + 1):
                piece = text[at:to]
                is_piece = starts.get(piece)
                if is_piece is None and to > at + 1:
                    break
                if (is_piece or to == at + 1) and last[to - base] is None:
                    good = seen.get((left, piece))
                    if fits(left, piece) if good is None else good:
                        last[to - base] = piece
                if is_piece is None:
                    break
            i += 1
            if i >= due and base + i < end:
                meet = self._meeting(last, i)
                yield from self._path(last, meet)
                base, i = base + meet, i - meet
                due = i + 2 * longest
                last = last[meet:] + [None] * max(0, due + 2 * longest - (len(last) - meet))
        yield from self._path(last, end - base)

    def _meeting(self, last: list[str | None], now: int) -> int:
        """The last boundary that the paths to ``now`` and to every boundary
        reached beyond it share."""
        on_path, at = {0}, now
        while at > 0:
            on_path.add(at)
            at -= len(last[at])
        meet = now
        for at in range(now + 1, min(now + self.v.longest, len(last))):
            if last[at] is not None:
                while at not in on_path:
                    at -= len(last[at])
                meet = min(meet, at)
        return meet

    @staticmethod
    def _path(last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= len(last[end])
        return out[::-1]

    def ids_of(self, piece: str) -> list[int]:
        known = self.v.ids.get(piece)
        if known is not None:
            return [known]
        return [self.v.byte_ids[x] for x in piece.encode()] if self.v.byte_ids else [self.v.unknown]

    def walk(self, text: str) -> list[int]:
        """Ids of a text that fits into one window."""
        number, pairs, longest, n = self._number, self._pairs, self.v.longest, len(text)
        total, many = len(self.v.pieces), len(self.v.pieces) + 0x110001
        last, start = [-1] * (n + 1), [-1] * (n + 1)  # of the piece that ends at each boundary
        for at in range(n):
            left = last[at]
            for to in range(at + 1, min(at + longest, n) + 1):
                piece = number.get(text[at:to])
                if piece is None:
                    if to > at + 1:
                        break
                    piece = total + ord(text[at])  # a character without a piece
                if piece >= 0 and start[to] < 0:
                    key = (left + 1) * many + piece
                    good = pairs.get(key)
                    if good is None:
                        if len(pairs) > MAX_FITS:
                            pairs.clear()
                        good = pairs[key] = self._left_alone(text[start[at] : at] if at else "", text[at:to])
                    if good:
                        last[to], start[to] = piece, at
                if piece >= total:
                    break
        out, at = [], n
        while at > 0:
            out += [last[at]] if last[at] < total else self.ids_of(text[start[at]])[::-1]
            at = start[at]
        return out[::-1]

    def _left_alone(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [x for x in (left, right) if x]

    def _parts(self, text: str) -> Iterator[str]:
        """Parts of bounded length, cut at spaces that begin a word. A part without such a
        space goes on to the next one."""
        at = 0
        while self.by_words and len(text) - at > PART_CHARS:
            to = text.rfind(" ", at + 1, at + PART_CHARS)
            while to > at and text[to - 1] in (" ", MARK):
                to = text.rfind(" ", at + 1, to)
            if to <= at:
                to = text.find(" ", at + PART_CHARS)
                while to > 0 and text[to - 1] in (" ", MARK):
                    to = text.find(" ", to + 1)
                if to < 0:
                    break
            yield text[at:to]
            at = to + 1
        yield text[at:]

    def _ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, as bytes. The empty word has none."""
        if len(self._new) > MAX_WORDS:
            self._old, self._new = self._new, {}
        new, old = self._new, self._old
        new[""] = b""
        short, known = [], self.lanes.known
        for word in words:
            if word not in new:
                ids = old.get(word)
                if ids is not None:
                    new[word] = ids
                elif len(word) > WINDOW:
                    new[word] = np.array([i for piece in self.stream(word) for i in self.ids_of(piece)], np.int32).tobytes()
                elif known.issuperset(word):
                    short.append(word)
                else:
                    new[word] = np.array(self.walk(word), np.int32).tobytes()
        for k in range(0, len(short), LANES):
            new.update(zip(part := short[k : k + LANES], self.lanes.walk(part), strict=True))
        return [new[w] for w in words]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ``ids[bounds[i]:bounds[i + 1]]``."""
        pc = pyarrow.compute
        texts = texts.cast(pa.large_string()).fill_null("")
        some = pc.greater(pc.binary_length(texts), 0)
        one, none = (pa.scalar(x, pa.large_string()) for x in (MARK, ""))
        marked = pc.if_else(some, pc.binary_join_element_wise(one, pc.replace_substring(texts, " ", MARK), none), none)
        if self.by_words and not pc.any(pc.match_substring(texts, _CUT)).as_py():
            # a cut before each run of marks; what lies before the first is empty
            lists = pc.split_pattern(pc.replace_substring_regex(marked, f"{MARK}+", _CUT + r"\0"), _CUT)
            words, count = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        else:
            lists = [_WORDS.findall(t) if self.by_words else [t] for t in marked.to_pylist()]
            words, count = pa.array([w for x in lists for w in x], pa.large_string()), np.array([len(x) for x in lists], np.int64)
        at = np.concatenate([[0], np.cumsum(count)])
        coded = words.dictionary_encode()
        held = self._ids(coded.dictionary.to_pylist())
        flat, size = np.frombuffer(b"".join(held), np.int32), np.array([len(x) for x in held], np.int64) // 4
        begin, of = np.cumsum(size) - size, coded.indices.to_numpy()
        each = size[of]
        end = np.concatenate([[0], np.cumsum(each)])
        return flat[np.repeat(begin[of] - end[:-1], each) + np.arange(end[-1])], end[at]

    def encode_long(self, text: str) -> np.ndarray:
        return np.concatenate([self.encode_all(pa.array([part], pa.large_string()))[0] for part in self._parts(text)])

    def encode(self, text: str) -> np.ndarray:
        return self.encode_long(text)


class _Lanes:
    """``Encoder.walk`` for many short words of known characters: position by position,
    pieces and pairs found in tables with open addressing."""

    def __init__(self, encoder: Encoder):
        self.encoder, pieces = encoder, encoder.v.pieces
        bytes_ = encoder.v.byte_ids
        # characters of one byte that no piece holds have one id too: that of the byte
        self.known = {MARK} | {c for p in encoder.v.ids for c in p} | {chr(b) for b in range(128) if b in bytes_}
        chars = {c: k + 1 for k, c in enumerate(sorted(self.known | {MARK}))}
        self.char, self.chars = np.zeros(0x110000, np.int32), len(chars) + 1
        self.char[[ord(c) for c in chars]] = [*chars.values()]
        node = {"": 0} | {p: k + 1 for k, p in enumerate(encoder._number)}
        rows = [(node[p[:-1]] * self.chars + chars[p[-1]], node[p], piece) for p, piece in encoder._number.items()]
        # a character that is no piece can stand alone
        rows += [(k, 0, len(pieces) + k) for c, k in chars.items() if c not in node]
        self.table, self.pairs = _Table(), _Table()
        self.single = np.array([bytes_.get(ord(c), -1) if c not in node and c.isascii() else -1 for c in ["é", *chars]], np.int32)
        rows = np.array(rows, np.int64)
        self.table.add(rows[:, 0], np.stack([rows[:, 1], np.zeros(len(rows), np.int64), rows[:, 2]], axis=1))
        self.many = len(pieces) + self.chars + 1
        self.text = [*pieces, "", *sorted(chars)]

    def _fit(self, left: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Which pieces can follow which (-1: none before)."""
        keys = (left + 1).astype(np.int64) * self.many + piece
        slot = self.pairs.find(keys)
        missing = np.flatnonzero(slot < 0)
        if len(missing):
            new = np.unique(keys[missing])
            if self.pairs.used + len(new) > MAX_PAIRS:
                self.pairs = _Table()
                new = np.unique(keys)
            good = [self.encoder._left_alone(self.text[k // self.many - 1] if k >= self.many else "", self.text[k % self.many]) for k in new.tolist()]
            self.pairs.add(new, np.stack([np.zeros(len(new), np.int64), np.array(good, np.int64), np.zeros(len(new), np.int64)], axis=1))
            slot = self.pairs.find(keys)
        return self.pairs.change[slot] > 0

    def walk(self, words: list[str]) -> list[bytes]:
        size = np.array([len(w) for w in words], np.int64)
        base = np.cumsum(size + 1) - size - 1  # boundaries 0 to size of each word
        points = np.frombuffer("\0".join(words).encode("utf-32-le"), np.uint32)
        char = np.append(self.char[points], 0)
        last, start = np.full(len(char), -1, np.int32), np.full(len(char), -1, np.int32)
        for at in range(int(size.max())):
            lanes = np.flatnonzero(size > at)
            left, place, node = last[base[lanes] + at], base[lanes] + at, np.zeros(len(lanes), np.int64)
            for _ in range(self.encoder.v.longest):
                slot = self.table.find(node * self.chars + char[place])
                on = slot >= 0
                slot, left, place = slot[on], left[on], place[on] + 1
                node, piece = self.table.next[slot].astype(np.int64), self.table.token[slot]
                ends = np.flatnonzero((piece >= 0) & (start[place] < 0))
                ends = ends[self._fit(left[ends], piece[ends])] if len(ends) else ends
                last[place[ends]], start[place[ends]] = piece[ends], at
                more = (char[place] > 0) & (node > 0)  # a word's last boundary has no character
                if not more.any():
                    break
                left, place, node = left[more], place[more], node[more]
        path, lanes, at = np.zeros(len(char), bool), np.arange(len(words)), size.copy()
        while len(lanes):
            path[base[lanes] + at[lanes]] = True
            at[lanes] = start[base[lanes] + at[lanes]]
            lanes = lanes[at[lanes] > 0]
        ids, total = last[path], len(self.encoder.v.pieces)
        alone = np.flatnonzero(ids >= total)
        byte = self.single[ids[alone] - total]
        ids[alone[byte >= 0]] = byte[byte >= 0]
        count = np.add.reduceat(path, base)
        end = np.cumsum(count)
        raw = ids.tobytes()
        out = [raw[4 * i : 4 * j] for i, j in zip((end - count).tolist(), end.tolist(), strict=True)]
        for k in set(np.searchsorted(end, np.flatnonzero(ids >= total), side="right").tolist()):
            out[k] = np.array(self.encoder.walk(words[k]), np.int32).tobytes()  # with bytes for a character
        return out


codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        plain = {"byte": lambda p: bytes([int(p[3:5], 16)]), "control": lambda _: b"", "unknown": lambda _: " \u2047 ".encode()}
        parts = [plain.get(k, lambda p: p.replace(MARK, " ").encode())(p) for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)]
        self.bytes = np.frombuffer(b"".join(parts), np.uint8)
        self.size = np.array([len(x) for x in parts], np.int32)
        self.at = (np.cumsum(self.size) - self.size).astype(np.int32)
        # the space that the encoder put before the text
        self.marked = np.array([k == "normal" and p.startswith(MARK) for p, k in zip(vocabulary.pieces, vocabulary.kinds, strict=True)])

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of the texts with the ids ``ids[bounds[i]:bounds[i + 1]]``."""
        size, at = self.size[ids], self.at[ids]
        some = bounds[:-1] < bounds[1:]
        first, last = bounds[:-1][some].copy(), bounds[1:][some] - 1
        while (silent := (size[first] == 0) & (first < last)).any():
            first[silent] += 1
        first = first[self.marked[ids[first]]]
        size[first] -= 1
        at[first] += 1
        end = np.concatenate([[0], np.cumsum(size)])
        flat = bytearray()
        for k in range(0, len(ids), DECODE_IDS):
            n = size[k : k + DECODE_IDS]
            flat += self.bytes[np.repeat(at[k : k + DECODE_IDS] - (np.cumsum(n) - n), n) + np.arange(n.sum())].tobytes()
        flat = memoryview(flat)
        return [bytes(flat[i:j]) for i, j in zip(end[bounds[:-1]], end[bounds[1:]], strict=True)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].decode(errors="each_byte")


_HELD: dict = {}


def _held(shared, kind):
    """One encoder and one decoder per worker: those of the vocabulary used last, also when
    another job shares it anew."""
    name = shared.value.name
    if _HELD.get("name") != name:
        _HELD.clear()
        _HELD["name"] = name
    if kind not in _HELD:
        _HELD[kind] = kind(shared.value)
    return _HELD[kind]


def share(spark: SparkSession, path: str):
    """The vocabulary file at ``path``, for the tasks. Its size is fixed."""
    return spark.sparkContext.broadcast(Vocabulary.read(path))


def encode_text(text: str | Column, shared) -> Column:
    """array<int> of piece ids."""

    @F.arrow_udf("array<int>")
    def run(column: pa.Array) -> pa.Array:
        encoder = _held(shared, Encoder)
        size = np.cumsum(pyarrow.compute.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lists, at = [], 0
        while at < len(column):
            # rows of about PART_CHARS bytes, one at least
            before = int(size[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + PART_CHARS, side="right")))
            if int(size[to - 1]) - before > PART_CHARS:
                ids = encoder.encode_long(column[at].as_py())
                bounds = np.array([0, len(ids)])
            else:
                ids, bounds = encoder.encode_all(column.slice(at, to - at))
            lists.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
            at = to
        if not lists:
            return pa.array([], pa.list_(pa.int32()))
        return pa.concat_arrays(lists)

    return run(text)


def decode_ids(ids: str | Column, shared) -> Column:
    """The text of an array<int> of piece ids."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        decoder = _held(shared, Decoder)
        out = []
        n = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
        end, k = np.cumsum(n), 0
        while k < len(column):
            # rows of about DECODE_IDS ids, one at least
            to = max(k + 1, int(np.searchsorted(end, end[k] - n[k] + DECODE_IDS, side="right")))
            part = column.slice(k, to - k).fill_null([])
            bounds = np.concatenate([[0], np.cumsum(n[k:to])]).astype(np.int64)
            texts = decoder.decode_all(part.flatten().to_numpy(zero_copy_only=False), bounds)
            out += [t.decode(errors="each_byte") for t in texts]
            k = to
        return pa.array(out, pa.string())

    return run(ids)


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, round_trip) per document row; ``round_trip`` says
    whether the ids decode to the very text."""
    shared = share(docs.sparkSession, path)
    out = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_text"), encode_text(docs[text], shared).alias("ids"))
    back = decode_ids("ids", shared) == F.col("_text")
    return out.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), back.alias("round_trip"))
