"""Benchmark decontamination: size-partitioned MinHash containment search.

The question is asymmetric: which short test items lie inside which long
documents. Documents are partitioned by the number of their shingles (powers of
two). Inside a partition, one-permutation MinHash splits the hash space into
bins, many enough for the partition's size that a shared shingle is the least of
its bin on both sides almost surely; an item and a document that agree on one
bin are a candidate pair. The bins of a partition follow from the smallest item
and ``miss``, the accepted probability of overlooking an item at the threshold.
Every candidate is verified on the full shingle sets, where the document lies:
no document moves.

The items are a stated query set that does not follow the corpus. Their signature
is shared with the tasks in blocks of ``ITEM_BYTES`` of text; more items mean
more blocks, each with its own pass over the documents.

Defined results: null, empty and blank texts contain nothing, and such items are
contained in nothing. Repeated rows each give their own pairs. Items of fewer
than five words are one shingle, which only a document of exactly these words
has. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import textblock as tb

CONTAINMENT = 0.75
MISS = 1e-6
ITEM_BYTES = 8 << 20


class ItemIndex:
    """Shingle sets of items and, per partition, the least hashes of their bins."""

    def __init__(self, ids: list, texts: list[bytes], miss: float = MISS, containment: float = CONTAINMENT):
        sets = [s for part in (tb.shingle_sets(b) for b in _blocks_of(texts)) for s in part]
        self.ids = [i for i, s in zip(ids, sets, strict=True) if len(s)]
        self.sets = [s for s in sets if len(s)]
        self.containment = containment
        smallest = min(map(len, self.sets), default=1)
        # of the shared shingles of the smallest item at the threshold, all must
        # share their bin with a smaller hash for the item to be overlooked
        crowded = miss ** (1 / math.ceil(containment * smallest))
        self.spare_bits = max(1, math.ceil(math.log2(1 / crowded)))
        self._least: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shift(self, partition: int) -> np.uint64:
        return np.uint64(64 - min(partition + self.spare_bits, 60))

    def least(self, partition: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted least hashes, their items) under the bins of a partition."""
        if partition not in self._least:
            parts = [least_of_bins(s, self._shift(partition)) for s in self.sets]
            hashes = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
            order = np.argsort(hashes, kind="stable")
            self._least[partition] = hashes[order], owner[order]
        return self._least[partition]

    def contained(self, s: np.ndarray) -> list[tuple[object, int, int]]:
        """(item, shared shingles, shingles of the item) of the items that a
        document with the sorted shingle set ``s`` contains."""
        if not len(s):
            return []
        partition = int(len(s) - 1).bit_length()
        hashes, owner = self.least(partition)
        own = least_of_bins(s, self._shift(partition))
        lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
        hit = np.flatnonzero(hi > lo)
        if not len(hit):
            return []
        found = []
        for i in np.unique(np.concatenate([owner[lo[k] : hi[k]] for k in hit])):
            item = self.sets[i]
            at = np.minimum(np.searchsorted(s, item), len(s) - 1)
            shared = int((s[at] == item).sum())
            if shared >= self.containment * len(item):
                found.append((self.ids[i], shared, len(item)))
        return found


def _blocks_of(texts: list[bytes]):
    return tb.blocks(pa.array(texts, pa.binary()))


def least_of_bins(s: np.ndarray, shift: np.uint64) -> np.ndarray:
    """The least hash of each filled bin of a sorted set; the top bits are the bin."""
    bins = s >> shift
    first = np.ones(len(s), bool)
    first[1:] = bins[1:] != bins[:-1]
    return s[first]


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", item_bytes: int = ITEM_BYTES, **options) -> list[Callable[[], ItemIndex]]:
    """Makers of the indexes of the items, each of about ``item_bytes`` of text."""
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-total // item_bytes))
    named = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))

    def maker(k: int):
        def make() -> ItemIndex:
            rows = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
            return ItemIndex([r["item_id"] for r in rows], [r["text"].encode() for r in rows], **options)

        return make

    return [maker(k) for k in range(n)]


def contained_items(text: str | Column, index: ItemIndex, id_type: str = "bigint") -> Column:
    """Array of (item_id, shared, n_item) of the items inside a text."""
    names = ["item_id", "shared", "n_item"]

    @F.arrow_udf(f"array<struct<item_id:{id_type},shared:long,n_item:long>>")
    def run(column: pa.Array) -> pa.Array:
        found = [[dict(zip(names, f, strict=True)) for f in index.contained(s)] for b in tb.blocks(column) for s in tb.shingle_sets(b)]
        item = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]
        return pa.array(found, pa.list_(pa.struct([("item_id", item), ("shared", pa.int64()), ("n_item", pa.int64())])))

    return run(text)


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """(doc_id, item_id, shared, n_item, containment): every item that a document
    holds at the threshold or more."""
    kind = items.schema["item_id"].dataType.simpleString()
    parts = []
    for make in item_blocks(items, **options):
        found = docs.select("doc_id", F.explode(contained_items(docs[text], make(), kind)).alias("found"))
        parts.append(found.select("doc_id", "found.*"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("containment", F.col("shared") / F.col("n_item"))


def drop_leaks(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without those that hold a test item; all columns stay."""
    kind = items.schema["item_id"].dataType.simpleString()
    for make in item_blocks(items, **options):
        docs = docs.where(F.size(contained_items(docs[text], make(), kind)) == 0)
    return docs
