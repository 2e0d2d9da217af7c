"""Toxicity: a convolutional text classifier in numpy.

Words are hashed to buckets; a word's vector is the sum of the embedding of the
whole word and that of its first bytes. Filters of several widths slide over the
words of the whole text, max pooling keeps each filter's strongest answer, and a
logistic layer sums them. Buckets that the labelled sample holds only once share
one neutral vector, so unseen words cannot fire a filter. Words start from their
log-odds in the sample, and output weights are not negative.

The languages of a corpus differ in how early the classifier answers. A part of
the sample is kept from training to pick one threshold per language; the text's
own function words tell its language. The score is moved so that 0.5 is the
threshold of that language.

Null and empty texts are scored as a text without words. Without labelled rows,
or with one class only, every score is the share of toxic rows (0 without rows).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import textblock as tb
from driftlens.llm.tables import LANGUAGES, held_out, labelled_sample, languages

SAMPLE_ROWS = 8_000
THRESHOLD = 0.5
BUCKETS = 1 << 18
WIDTHS = {1: 16, 2: 8, 3: 8}
GROUPS = 8
_MASK = np.uint64(BUCKETS - 1)


def bucket_pairs(b: tb.Block) -> np.ndarray:
    """(2, words) buckets: of each word, and of its first bytes."""
    return np.stack([(b.hashes & _MASK).astype(np.int32), (b.heads & _MASK).astype(np.int32) + BUCKETS])


def _padded(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with neutral ones after each text, so that no window spans two
    texts, and where each text then starts."""
    pad = max(WIDTHS) - 1
    starts = at[:-1] + pad * np.arange(len(at) - 1)
    out = np.zeros((rows.shape[0], rows.shape[1] + pad * (len(at) - 1)), rows.dtype)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    out[:, np.arange(rows.shape[1]) + pad * owner] = rows
    return out, starts


def _pool(answers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Strongest answer per text, not below 0."""
    return np.maximum(np.maximum.reduceat(answers, starts, axis=0), 0)


@dataclass
class ConvModel:
    """``row_of`` maps a bucket to its embedding row (0: the neutral one);
    ``filters[w]`` has shape (w, dims, filters); ``shift`` is the threshold of
    each language, as log-odds."""

    row_of: np.ndarray
    vectors: np.ndarray
    filters: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    weights: np.ndarray
    bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    constant: float | None = None

    def projections(self) -> dict[int, list[np.ndarray]]:
        """What each embedding row adds to each filter at each offset."""
        return {w: [self.vectors @ f[k] for k in range(w)] for w, f in self.filters.items()}

    def logits(self, pairs: np.ndarray, at: np.ndarray, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        rows, starts = _padded(at, self.row_of[pairs])
        pooled = []
        for w, parts in tables.items():
            n = rows.shape[1] - w + 1
            answers = np.repeat(self.biases[w][None, :], n, axis=0)
            for k, part in enumerate(parts):
                for source in rows:
                    seen = np.flatnonzero(source[k : k + n])  # row 0 adds nothing
                    answers[seen] += part[source[k : k + n][seen]]
            pooled.append(_pool(answers, starts))
        return np.concatenate(pooled, axis=1) @ self.weights + self.bias

    def score(self, b: tb.Block, tables: dict[int, list[np.ndarray]]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(b), self.constant)
        z = self.logits(bucket_pairs(b), b.word_at, tables) - self.shift[languages(b)]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _thresholds(z: np.ndarray, y: np.ndarray, lang: np.ndarray) -> np.ndarray:
    """Log-odds per language at which the most rows fall on the right side, in
    the middle of the gap around it; languages with few toxic rows take the
    threshold of all rows."""

    def best(zs: np.ndarray, ys: np.ndarray) -> float:
        order = np.argsort(zs, kind="stable")
        zs, ys = zs[order], ys[order]
        # rows from i on count as toxic
        right = np.concatenate([[ys.sum()], ys.sum() - np.cumsum(ys) + np.cumsum(1 - ys)])
        top = np.flatnonzero(right == right.max())
        cuts = np.concatenate([[zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]])
        return float(np.clip(np.median(cuts[top]), -4, 4))

    overall = best(z, y)
    out = np.full(len(LANGUAGES), overall)
    for i in range(len(LANGUAGES)):
        own = lang == i
        if y[own].sum() >= 20 and (1 - y[own]).sum() >= 20:
            out[i] = best(z[own], y[own])
    return out


def fit_conv(
    texts: list[np.ndarray], y: np.ndarray, lang: np.ndarray, dims: int = 12, epochs: int = 4, batch: int = 48,
    rate: float = 0.08, seed: int = 7, least: int = 2, steps: int = 300,
) -> ConvModel:
    """Trains on (2, words) bucket arrays with Adagrad, for ``epochs`` passes and
    at least ``steps`` steps; every fifth text only sets thresholds."""
    if not len(y) or y.min() == y.max():
        empty = np.zeros(0)
        return ConvModel(empty, empty, {}, {}, empty, 0.0, constant=float(y[0]) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    place = np.arange(len(y))
    aside = place % 5 == 4
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    train = place[~aside]
    counts = np.zeros((2, 2 * BUCKETS), np.int32)  # texts of each class that hold a bucket
    for i in train:
        counts[int(y[i]), np.unique(texts[i])] += 1
    df = counts.sum(axis=0)
    known = np.flatnonzero(df >= least)
    row_of = np.zeros(2 * BUCKETS, np.int32)
    row_of[known] = np.arange(1, len(known) + 1)
    vectors = np.vstack([np.zeros(dims), rng.normal(0, 0.1, (len(known), dims))]).astype(np.float32)
    filters = {w: rng.normal(0, 1 / np.sqrt(w * dims), (w, dims, f)).astype(np.float32) for w, f in WIDTHS.items()}
    # Max pooling passes a gradient to one word a text, so words that matter would
    # rarely be found from a random start: each starts with its log-odds in one of
    # GROUPS components, which the first filters read. Several toxic words then add up.
    sizes = np.bincount(y[train].astype(int), minlength=2)
    odds = np.log((counts[1, known] + 0.5) / (sizes[1] + 1)) - np.log((counts[0, known] + 0.5) / (sizes[0] + 1))
    odds = np.maximum(odds, 0) * df[known] / (df[known] + 3)
    vectors[1:, :GROUPS] = 0
    vectors[1 + np.arange(len(known)), tb.mix(known.astype(np.uint64)) % np.uint64(GROUPS)] = 0.3 * odds
    filters[1][0, :, :GROUPS] = np.eye(dims, GROUPS)
    biases = {w: np.zeros(f, np.float32) for w, f in WIDTHS.items()}
    weights = rng.normal(0.3, 0.1, sum(WIDTHS.values())).astype(np.float32)
    model = ConvModel(row_of, vectors, filters, biases, weights, float(np.log(y.mean() / (1 - y.mean()))))
    rows = [row_of[t] for t in texts]
    heat = {"v": np.full(vectors.shape, 1e-2, np.float32), "o": np.full(len(weights), 1e-2), "b": 1e-2,
            **{("f", w): np.full(f.shape, 1e-2) for w, f in filters.items()}, **{("b", w): np.full(len(x), 1e-2) for w, x in biases.items()}}

    def step(key, slope):
        heat[key] = heat[key] + slope * slope
        return rate * slope / np.sqrt(heat[key])

    for _ in range(max(epochs, -(-steps * batch // len(train)))):
        order = rng.permutation(train)
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            bounds = np.concatenate([[0], np.cumsum([rows[i].shape[1] for i in picked])])
            seen, starts = _padded(bounds, np.concatenate([rows[i] for i in picked], axis=1))
            # rows that add nothing need no matrix product
            live = np.flatnonzero(seen.any(axis=0))
            x = np.zeros((seen.shape[1], dims), np.float32)
            x[live] = vectors[seen[0, live]] + vectors[seen[1, live]]
            ends = np.concatenate([starts[1:], [seen.shape[1]]])
            pooled, where = [], {}
            for w, f in filters.items():
                n = seen.shape[1] - w + 1
                answers = biases[w] + sum(x[k : k + n] @ f[k] for k in range(w))
                # the last text's window ends inside its padding
                strongest = np.stack([s + answers[s : max(min(e, n), s + 1)].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                where[w] = strongest
                pooled.append(np.maximum(answers[strongest, np.arange(f.shape[2])], 0))
            h = np.concatenate(pooled, axis=1)
            p = 1 / (1 + np.exp(-np.clip(h @ model.weights + model.bias, -30, 30)))
            err = (p - y[picked]) / len(picked)
            back = np.outer(err, model.weights) * (h > 0)
            # filters only speak for toxicity: words of clean texts cannot outvote them
            model.weights = np.maximum(model.weights - step("o", h.T @ err), 0).astype(np.float32)
            model.bias -= float(step("b", err.sum()))
            slopes = np.zeros_like(x)
            col = 0
            for w, f in filters.items():
                g = back[:, col : col + f.shape[2]].astype(np.float32)
                col += f.shape[2]
                grad = np.zeros_like(f)
                for k in range(w):
                    spots = where[w] + k
                    grad[k] = np.einsum("tfd,tf->df", x[spots], g)
                    np.add.at(slopes, spots.ravel(), (g[:, :, None] * f[k].T[None]).reshape(-1, dims))
                f -= step(("f", w), grad).astype(np.float32)
                biases[w] -= step(("b", w), g.sum(axis=0)).astype(np.float32)
            hit = np.flatnonzero(slopes.any(axis=1))
            for source in seen:
                own, back_at = np.unique(source[hit], return_inverse=True)
                total = np.zeros((len(own), dims), np.float32)
                np.add.at(total, back_at, slopes[hit])
                heat["v"][own] += total * total
                vectors[own] -= rate * total / np.sqrt(heat["v"][own])
            vectors[0] = 0
    tables = model.projections()
    check = np.flatnonzero(aside) if aside.any() else train
    z = np.concatenate([
        model.logits(np.concatenate([texts[i] for i in part], axis=1), np.concatenate([[0], np.cumsum([texts[i].shape[1] for i in part])]), tables)
        for part in np.array_split(check, max(1, len(check) // 200))
    ])
    model.shift = _thresholds(z, y[check], lang[check])
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", rows: int = SAMPLE_ROWS) -> ConvModel:
    """Fits the classifier on at most ``rows`` labelled documents outside the
    held-out fold. Their whole texts become bucket numbers on the executors;
    the driver gets those of ``rows`` documents and trains."""

    @F.arrow_udf("struct<lang:int,words:binary>")
    def encode(column: pa.Array) -> pa.Array:
        lang, packed = [], []
        for b in tb.blocks(column):
            pairs = bucket_pairs(b)
            lang.extend(languages(b).tolist())
            packed.extend(pairs[:, i:j].tobytes() for i, j in zip(b.word_at[:-1], b.word_at[1:], strict=True))
        return pa.StructArray.from_arrays([pa.array(lang, pa.int32()), pa.array(packed, pa.binary())], ["lang", "words"])

    sample = labelled_sample(docs, labels, target, rows)
    got = sample.select("doc_id", "label", encode("text").alias("e")).select("doc_id", "label", "e.*").limit(2 * rows).toPandas()
    got = got.sort_values("doc_id", kind="stable")
    texts = [np.frombuffer(w, np.int32).reshape(2, -1) for w in got["words"]]
    y, lang = got["label"].to_numpy(float), got["lang"].to_numpy()
    return fit_conv(texts, y, lang)


def toxicity_score(text: str | Column, model: ConvModel) -> Column:
    """Score of each text, 0 to 1; 0.5 is the threshold of its language."""

    @F.arrow_udf("double")
    def run(column: pa.Array) -> pa.Array:
        tables = model.projections()
        return pa.array(np.concatenate([model.score(b, tables) for b in tb.blocks(column)]), pa.float64())

    return run(text)


def score_toxicity(docs: DataFrame, model: ConvModel, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document row."""
    scored = docs.select("doc_id", held_out().alias("held_out"), toxicity_score("text", model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
