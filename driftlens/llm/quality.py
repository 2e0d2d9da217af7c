"""Quality classifier: a generalised additive model with pairwise interactions.

Each document becomes some twenty numbers (its length, the shares of kinds of
characters, repetition, function words). Shallow trees over the bins of one
feature at a time are boosted in turn and summed into one lookup table per
feature; then the pairs of features that explain most of what is left get small
two-dimensional tables the same way. A score is a sum of table cells, looked up
for a whole block of documents at once.

Null and empty texts are scored like any other text (all counts are zero). With
no labelled rows, or labels of one class only, every score is the share of that
class (``EMPTY_SCORE`` without labels).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import textblock as tb
from driftlens.llm.tables import function_word_counts, held_out, labelled_sample

SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
EMPTY_SCORE = 1.0
FEATURES = [
    "log_bytes", "log_words", "word_length", "upper", "digits", "symbols", "bars", "shouts", "stops", "newlines",
    "not_ascii", "same_as_last", "distinct_words", "distinct_triples", "repeated_shingles", "function_words",
]


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = {
    "upper": _is(bytes(range(65, 91))), "letters": _is(bytes([*range(65, 91), *range(97, 123)])),
    "digits": _is(b"0123456789"), "symbols": _is(b"#$%&*@^~<>=+_\\/{}[]`"), "bars": _is(b"|"), "shouts": _is(b"!?"),
    "stops": _is(b".,;:"), "newlines": _is(b"\n"), "not_ascii": _is(bytes(range(128, 256))), "space": tb.SPACE,
}


def _distinct_share(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    return tb.distinct_counts(hashes, at) / np.maximum(np.diff(at), 1)


def features(b: tb.Block) -> np.ndarray:
    """(texts, FEATURES) as float32."""
    size = np.maximum(b.last - b.first, 1).astype(float)
    spans = np.concatenate([b.first, b.last[-1:] + 1])
    count = {k: tb.segment_counts(m[b.data], spans) for k, m in _KINDS.items()}
    for k in ("newlines", "space"):
        count[k] = count[k] - 1  # the separator after each text
    n_words = np.diff(b.word_at)
    some = np.maximum(n_words, 1)
    same = np.zeros(len(b.hashes), bool)
    same[1:] = b.hashes[1:] == b.hashes[:-1]
    inner = b.word_at[:-1][n_words > 0]
    same[inner] = False
    triples, triple_at = tb.shingle_hashes(b, 3)
    fives, five_at = tb.shingle_hashes(b, 5)
    out = {
        "log_bytes": np.log1p(b.last - b.first), "log_words": np.log1p(n_words),
        "word_length": (size - count["space"]) / some, "upper": count["upper"] / np.maximum(count["letters"], 1),
        **{k: count[k] / size for k in ("digits", "symbols", "bars", "shouts", "stops", "newlines", "not_ascii")},
        "same_as_last": tb.segment_counts(same, b.word_at) / some, "distinct_words": _distinct_share(b.hashes, b.word_at),
        "distinct_triples": _distinct_share(triples, triple_at), "repeated_shingles": 1 - _distinct_share(fives, five_at),
        "function_words": function_word_counts(b).sum(axis=1) / some,
    }
    return np.stack([out[k] for k in FEATURES], axis=1).astype(np.float32)


@dataclass
class AdditiveModel:
    """``tables[j]`` holds one number per bin of feature j; ``pairs`` holds
    (j, k, coarse edges of j, of k, table) for each interaction."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        total = np.full(len(x), self.base)
        for j, (edges, cells) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += cells[np.searchsorted(edges, x[:, j], side="right")]
        for j, k, ej, ek, cells in self.pairs:
            total += cells[np.searchsorted(ej, x[:, j], side="right"), np.searchsorted(ek, x[:, k], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]).astype(np.float32))


def _gain(g, h, ridge: float):
    return g * g / (h + ridge)


def _line_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values, per bin, of a tree with at most ``leaves`` leaves over bins
    in order; the leaf that gains most is cut next."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])

    def best(lo: int, hi: int):
        if hi - lo < 2:
            return -1.0, lo
        mid = np.arange(lo + 1, hi)
        left = _gain(cg[mid] - cg[lo], ch[mid] - ch[lo], ridge)
        right = _gain(cg[hi] - cg[mid], ch[hi] - ch[mid], ridge)
        gains = left + right - _gain(cg[hi] - cg[lo], ch[hi] - ch[lo], ridge)
        i = int(gains.argmax())
        return float(gains[i]), int(mid[i])

    spans = [(*best(0, len(g)), 0, len(g))]
    while len(spans) < leaves:
        i = max(range(len(spans)), key=lambda s: spans[s][0])
        gain, mid, lo, hi = spans[i]
        if gain <= 1e-9:
            break
        spans[i : i + 1] = [(*best(lo, mid), lo, mid), (*best(mid, hi), mid, hi)]
    out = np.zeros(len(g))
    for _, _, lo, hi in spans:
        out[lo:hi] = (cg[hi] - cg[lo]) / (ch[hi] - ch[lo] + ridge)
    return out


def _quarter_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a grid into four rectangles."""
    cg, ch = np.zeros((g.shape[0] + 1, g.shape[1] + 1)), np.zeros((g.shape[0] + 1, g.shape[1] + 1))
    cg[1:, 1:], ch[1:, 1:] = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def parts(c):
        a, top, left, whole = c[1:-1, 1:-1], c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return a, top - a, left - a, whole - top - left + a

    if min(g.shape) < 2:
        return 0.0, np.zeros(g.shape)
    gs, hs = parts(cg), parts(ch)
    gains = sum(_gain(a, b, ridge) for a, b in zip(gs, hs, strict=True))
    i, k = np.unravel_index(int(gains.argmax()), gains.shape)
    out = np.zeros(g.shape)
    for where, a, b in zip(((slice(0, i + 1), slice(0, k + 1)), (slice(0, i + 1), slice(k + 1, None)), (slice(i + 1, None), slice(0, k + 1)), (slice(i + 1, None), slice(k + 1, None))), gs, hs, strict=True):
        out[where] = a[i, k] / (b[i, k] + ridge)
    return float(gains[i, k]), out


def fit_additive(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, bins: int = 64,
    coarse: int = 12, leaves: int = 3, rate: float = 0.15, ridge: float = 4.0,
) -> AdditiveModel:
    """Cyclic boosting with Newton steps on the logistic loss."""
    if not len(y):
        return AdditiveModel(constant=EMPTY_SCORE)
    if y.min() == y.max():
        return AdditiveModel(constant=float(y[0]))
    base = float(np.log(y.mean() / (1 - y.mean())))
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, at in enumerate(cell):
            g, h = slopes()
            step = rate * _line_tree(np.bincount(at, g, len(tables[j])), np.bincount(at, h, len(tables[j])), leaves, ridge)
            tables[j] += step
            total += step[at]
    rough = [_edges(x[:, j], coarse) for j in range(x.shape[1])]
    spot = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(rough)]

    def grids(j: int, k: int):
        g, h = slopes()
        shape = (len(rough[j]) + 1, len(rough[k]) + 1)
        at = spot[j] * shape[1] + spot[k]
        return at, [np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h)]

    found = sorted(((-_quarter_tree(*grids(j, k)[1], ridge)[0], j, k) for j in range(len(rough)) for k in range(j)))
    chosen = {(j, k): np.zeros((len(rough[j]) + 1, len(rough[k]) + 1)) for _, j, k in found[:pairs]}
    for _ in range(pair_rounds):
        for (j, k), cells in chosen.items():
            at, (g, h) = grids(j, k)
            step = rate * _quarter_tree(g, h, ridge)[1]
            cells += step
            total += step.ravel()[at]
    return AdditiveModel(base, edges, tables, [(j, k, rough[j], rough[k], c) for (j, k), c in chosen.items()])


def text_features(text: str | Column) -> Column:
    """The feature vector of a text column, as array<float>."""

    @F.arrow_udf("array<float>")
    def run(column: pa.Array) -> pa.Array:
        x = np.concatenate([features(b) for b in tb.blocks(column)])
        return pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))

    return run(text)


def train_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = SAMPLE_ROWS) -> AdditiveModel:
    """Fits the model on at most ``rows`` labelled documents outside the
    held-out fold. Features are taken from whole texts on the executors; the
    driver gets ``rows`` short vectors."""
    sample = labelled_sample(docs, labels, target, rows)
    got = sample.select("doc_id", "label", text_features("text").alias("x")).limit(2 * rows).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    x = np.stack([np.asarray(v, np.float32) for v in got["x"]]) if len(got) else np.zeros((0, len(FEATURES)), np.float32)
    return fit_additive(x, got["label"].to_numpy(float))


def quality_score(text: str | Column, model: AdditiveModel) -> Column:
    """Score of each text, 0 to 1."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        return pa.array(np.concatenate([model.score(features(b)) for b in tb.blocks(column)]), pa.float64())

    return run(text)


def score_quality(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document row."""
    scored = docs.select("doc_id", held_out().alias("held_out"), quality_score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the model accepts, with all their columns."""
    return docs.where(quality_score(docs["text"], model) >= threshold)
