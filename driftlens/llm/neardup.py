"""MinHash near-dedup: one-permutation hashing, optimal densification, bands,
star-shaped candidate edges and an exact check.

A document is the set of its distinct 5-word shingles (A-Z lower-cased); with
fewer words, its whole word sequence. One hash per shingle chooses a bin and a
value; each bin keeps its least value, and an empty bin takes over that of the
first filled bin in its own fixed random order of bins. Bins are banded into
bucket keys.

Few shingles fill few bins, and bins that copy each other's values agree or differ together,
so estimates of small sets would vary too much. Sets of under ``WIDE`` shingles are
hashed with one function per bin instead; sets from ``NARROW`` on with the one
permutation; sets between the two have both signatures, so that any two sets that can be
linked have one in common.

1. Documents of equal sets collapse first, so a group of copies of any size is
   one node afterwards.
2. Each bucket links its members to its smallest member only: a bucket of m
   members gives m - 1 candidate edges.
3. Candidates whose signatures agree on too few bins (five standard deviations
   below the threshold) are dropped; the others are confirmed on the full sets.
4. Members of one bucket that the confirmed edges did not bring together are
   compared once more, in blocks of a fixed size and only across components, by
   signature and then on the full sets where they lie; only links leave the
   tasks. So a bucket's choice of its centre loses no link.

At similarity 0.75 a pair shares none of the 32 bands of 4 bins with a
probability of 5e-6; a signature of ``NARROW`` shingles or one function per bin falls below
the agreement with less than that (``test_recall_at_the_threshold`` counts both).

Defined results: null, empty and blank texts have an empty set and stay alone.
Rows of equal doc_id are one document node; each row is returned. Rows without a
doc_id stay alone, with a null component. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm import textblock as tb
from driftlens.llm.bitfilter import ROW_SCHEMA, build_filter, slice_rows
from driftlens.operators.links import connected_components
from driftlens.session import cut_lineage

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
BINS = BANDS * ROWS
_BIN_SHIFT = np.uint64(64 - 7)
NARROW, WIDE = 288, 384  # 100 * NARROW = 75 * WIDE: one of two linked sets is in both kinds or both are in one
AGREEMENT = 0.55
BLOCK = 512
FILTER_BYTES = 32 << 20


def bin_minima(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, least values) of a sorted set of hashes; the top bits are the bin."""
    bins = (s >> _BIN_SHIFT).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    return bins[first], s[first]


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fills the empty bins of each row: bin j tries the bins that a hash of
    (j, attempt) names until one is filled. Rows without any stay as they are."""
    out = values.copy()
    row, col = np.nonzero(~filled & filled.any(axis=1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        donor = (tb.mix(col.astype(np.uint64) + np.uint64(attempt << 20)) % np.uint64(values.shape[1])).astype(np.int64)
        found = filled[row, donor]
        out[row[found], col[found]] = values[row[found], donor[found]]
        row, col = row[~found], col[~found]
    return out


_OF_BIN = tb.mix(np.arange(1, BINS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS) densified one-permutation MinHash values."""
    values, filled = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), bool)
    for i, s in enumerate(sets):
        bins, least = bin_minima(s)
        values[i, bins], filled[i, bins] = least, True
    return densify(values, filled)


def small_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, BINS) MinHash values with a function per bin; 0 for empty sets."""
    out = np.zeros((len(sets), BINS), np.uint64)
    for i, s in enumerate(sets):
        if len(s):
            out[i] = ((s[:, None] ^ _OF_BIN) * (_OF_BIN | np.uint64(1))).min(axis=0)
    return tb.mix(out)


def both_signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(small signatures, which sets have one, wide signatures, which have one)."""
    n = np.array([len(s) for s in sets])
    few, many = n < WIDE, n >= NARROW
    small, wide = np.zeros((len(sets), BINS), np.uint64), np.zeros((len(sets), BINS), np.uint64)
    small[few] = small_signatures([s for s, f in zip(sets, few, strict=True) if f])
    wide[many] = signatures([s for s, m in zip(sets, many, strict=True) if m])
    return small, few, wide, many


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys."""
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(32), (len(sig), BANDS)).copy()
    for r in range(ROWS):
        total = tb.mix(total ^ sig[:, r::ROWS])
    return total.view(np.int64)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for b in tb.blocks(batch.column(1)):
            sets = tb.shingle_sets(b, SHINGLE)
            small, few, wide, many = both_signatures(sets)
            keys = np.concatenate([band_keys(small), band_keys(wide) ^ 1], axis=1)
            absent = np.repeat(np.stack([~few, ~many], axis=1), BANDS, axis=1)
            low = [(x & np.uint64(0xFFFF)).astype(np.uint16) for x in (small, wide)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(at, len(b)), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(pa.array(keys.ravel(), mask=absent.ravel()), 2 * BANDS).cast(pa.list_(pa.int64())),
                    pa.array([(a.tobytes() if f else b"") + (b.tobytes() if m else b"") for a, f, b, m in zip(low[0], few, low[1], many, strict=True)], pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_id", "buckets", "low"],
            )
            at += len(b)


def describe(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, buckets, low) per document row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(
        _describe, f"doc_id {kind}, n_shingles long, set_id binary, buckets array<long>, low binary"
    )


def _signature_table(n: np.ndarray, low: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(small, wide) signatures of sets of sizes ``n``; absent ones are zero."""
    out = np.zeros((2, len(low), BINS), np.uint16)
    for kind, rows, at in ((0, n < WIDE, 0), (1, n >= NARROW, -2 * BINS)):
        for i in np.flatnonzero(rows):
            out[kind, i] = np.frombuffer(low[i], np.uint16, BINS, at % len(low[i]))
    return out[0], out[1]


def _agreement(a_n: pa.Array, a: pa.Array, b_n: pa.Array, b: pa.Array) -> pa.Array:
    """Share of equal bins, in the kind of signature that both sets have."""
    (n, x), (m, y) = ((k.to_numpy(), _signature_table(k.to_numpy(), v.to_pylist())) for k, v in ((a_n, a), (b_n, b)))
    kind = (np.maximum(n, m) >= WIDE)[:, None]
    return pa.array((np.where(kind, x[1], x[0]) == np.where(kind, y[1], y[0])).mean(axis=1), pa.float64())


def _overlap(a: pa.Array, b: pa.Array) -> pa.Array:
    out = [
        len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)
    ]
    return pa.array(out, pa.int64())


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield slice_rows(batch.column(0).to_numpy().view(np.uint64))


def _set_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            part = batch.take(pa.array(np.flatnonzero(shared.value.has(hashes))))
            at = 0
            for b in tb.blocks(part.column(1)):
                sets = tb.shingle_sets(b, SHINGLE)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).slice(at, len(b)), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                    ["doc_id", "n", "shingles"],
                )
                at += len(b)

    return run


def _full_sets(docs: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(doc_id, n, shingles) of the ``wanted`` documents. Whole texts are read
    again where they lie; a filter of a fixed size keeps the sets of other
    documents from moving."""
    wanted = wanted.distinct()
    hashes = cut_lineage(wanted.select(F.xxhash64("doc_id").alias("h")).mapInArrow(_id_hashes, ROW_SCHEMA), "pair-ids")
    n = hashes.agg(F.sum("n")).first()[0] or 0
    shared = docs.sparkSession.sparkContext.broadcast(build_filter(hashes, n, 16, FILTER_BYTES, repeated=False))
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.col(text).alias("text"), F.xxhash64("doc_id").alias("h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return cut_lineage(named.mapInArrow(_set_rows(shared), f"doc_id {kind}, n long, shingles binary"), "pair-sets")


def _with_sides(pairs: DataFrame, sides: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the columns of both of its documents, as a_... and b_..."""
    for side in ("a", "b"):
        own = sides.select(F.col("doc_id").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        pairs = pairs.join(own, side)
    return pairs


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes allow the similarity and whose signatures agree well
    enough."""
    agreement = F.arrow_udf(_agreement, "double")
    both = _with_sides(pairs, nodes, "n", "low").where(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
    return both.where(agreement("a_n", "a_low", "b_n", "b_low") >= AGREEMENT).select("a", "b")


def _confirmed(docs: DataFrame, pairs: DataFrame, text: str, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    overlap = F.arrow_udf(_overlap, "long")
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    both = _with_sides(pairs, _full_sets(docs, named, text), "n", "shingles")
    both = both.select("a", "b", "a_n", "b_n", overlap("a_shingles", "b_shingles").alias("common"))
    return both.where(F.col("common") * 100 >= (F.col("a_n") + F.col("b_n") - F.col("common")) * percent).select("a", "b")


def _shared_counts(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Size of the intersection of a sorted set with each of others."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(one, flat), len(one) - 1)
    bounds = np.concatenate([[0], np.cumsum([len(o) for o in others])])
    return tb.segment_counts(one[at] == flat, bounds)


def _links_across(rows: list[tuple], bucket: int, percent: int) -> list[tuple]:
    """Links between members of different components in one group of rows
    (doc_id, component, own block, low, buckets, shingles). A pair that shares
    several buckets is left to the first; signatures choose the pairs to verify
    on the full sets, and what a link joins is one component from then on."""
    node, comp, own, low, keys, sets = zip(*rows, strict=True)
    comp, own = np.unique(comp, return_inverse=True)[1], np.array(own)
    keys = np.array([[k or 0 for k in row] for row in keys], np.int64)
    sets = [np.frombuffer(x, np.uint64) for x in sets]
    n = np.array([len(x) for x in sets])
    small, wide = _signature_table(n, low)
    split, band = len(set(own.tolist())) > 1, int(np.flatnonzero(keys[0] == bucket)[0])
    found = []
    for i in range(len(node) - 1):
        rest = np.flatnonzero(comp[i + 1 :] != comp[i]) + i + 1
        if split:  # pairs of one block are compared in its own group
            rest = rest[own[rest] != own[i]]
        rest = rest[np.minimum(n[rest], n[i]) * 100 >= np.maximum(n[rest], n[i]) * percent]
        kind = (np.maximum(n[rest], n[i]) >= WIDE)[:, None]
        rest = rest[np.where(kind, wide[rest] == wide[i], small[rest] == small[i]).mean(axis=1) >= AGREEMENT]
        rest = rest[((keys[rest] == keys[i]) & (keys[i] != 0)).argmax(axis=1) == band]
        if len(rest):
            common = _shared_counts(sets[i], [sets[k] for k in rest])
            for k in rest[common * 100 >= (n[rest] + n[i] - common) * percent]:
                if comp[k] != comp[i]:
                    found.append((min(node[i], node[k]), max(node[i], node[k])))
                    comp[comp == comp[k]] = comp[i]
    return found


def _across(percent: int, kind: pa.DataType):
    """Links inside each group (bucket, lo, hi). Groups arrive whole and sorted;
    each has about two blocks of rows at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def flush():
            found = _links_across(rows, key[0], percent) if len(rows) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], kind), pa.array([p[1] for p in found], kind)], ["a", "b"])

        for batch in batches:
            for *now, node, comp, own, low, keys, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    yield flush()
                    key, rows = now, []
                rows.append((node, comp, own, low, keys, shingles))
        yield flush()

    return run


def _left_apart(crowded: DataFrame, components: DataFrame) -> DataFrame:
    """(bucket, doc_id, component, blocks): bucket mates in different components,
    the bucket's centre aside (its pairs were all tested)."""
    comp = components.select(F.col("node").alias("doc_id"), "component")
    rest = crowded.where("doc_id != centre AND m > 2").join(comp, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    rest = cut_lineage(rest, "near-mates")
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count("*").alias("_m")).where("_lo < _hi")
    mixed = cut_lineage(mixed.select("bucket", F.ceil(F.col("_m") / BLOCK).alias("blocks")), "near-mixed")
    return rest.join(mixed, "bucket").select("bucket", "doc_id", "component", "blocks")


def _linked_mates(docs: DataFrame, apart: DataFrame, nodes: DataFrame, text: str, percent: int) -> DataFrame:
    """Links between the mates that were left apart."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    sets = _full_sets(docs, apart.select("doc_id"), text).select("doc_id", "shingles")
    rows = apart.join(nodes.select("doc_id", "low", "buckets"), "doc_id").join(sets, "doc_id")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rows = rows.select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "doc_id", "component", "own", "low", "buckets", "shingles")
    groups = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    name = kind.simpleString()
    return groups.mapInArrow(_across(percent, to_arrow_type(kind)), f"a {name}, b {name}")


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per document row: the documents
    linked at ``percent`` or more, by whole components; the smallest doc_id of a
    component is kept."""
    rows = cut_lineage(describe(docs, text), "near-rows")
    named = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = cut_lineage(
        named.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"), F.first("low").alias("low")),
        "near-nodes",
    )
    members = nodes.select("doc_id", F.explode("buckets").alias("bucket")).where("bucket IS NOT NULL")
    centres = members.groupBy("bucket").agg(F.min("doc_id").alias("centre"), F.max("doc_id").alias("_hi"), F.count("*").alias("m")).where("centre < _hi")
    crowded = cut_lineage(members.join(centres.drop("_hi"), "bucket"), "near-buckets")
    star = crowded.where("doc_id != centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b")).distinct()
    star = cut_lineage(_plausible(star, nodes, percent), "near-stars")
    links = cut_lineage(_confirmed(docs, star, text, percent), "near-links")
    components = connected_components(links, "a", "b")
    apart = cut_lineage(_left_apart(crowded, components), "near-apart")
    if not apart.isEmpty():
        more = cut_lineage(_linked_mates(docs, apart, nodes, text, percent), "near-links")
        components = connected_components(links.union(more), "a", "b")
    named_sets = nodes.select("set_id", F.col("doc_id").alias("node")).join(components, "node", "left")
    named_sets = named_sets.select("set_id", F.coalesce("component", "node").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "set_id").join(named_sets, "set_id", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one_of_each(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that another one of their group stands
    for; all columns stay. Rows without a doc_id stay."""
    gone = near_duplicates(docs, text, percent).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*docs.columns)
