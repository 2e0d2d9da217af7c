"""Line dedup behind two Bloom filters.

A first pass sends one 64-bit hash per distinct line and text: no line text
moves. Tasks that own slices of the bit space set a bit pair in the once-seen
filter, and in the twice-seen filter when the first already had it. Only the
twice-seen filter is shared, and its size has a fixed bound
(``max_filter_bytes``); a fuller filter sends more lines to confirmation but
never changes the result. In a second pass the lines that the filter suspects
shuffle as (128-bit digest, document) and are counted exactly; the largest
document keeps a repeated line.

Defined results: a null or empty text is one empty line. Rows of equal doc_id
are one document when repeats are counted, and each row is returned. Lines of
rows without a doc_id are neither counted nor dropped. An empty table gives an
empty result. Other columns pass through ``drop_repeated_lines`` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.bitfilter import ROW_SCHEMA, BitFilter, build_filter, slice_rows
from driftlens.llm.tables import fresh
from driftlens.llm.textblock import text_bytes
from driftlens.session import cut_lineage

MIN_CHARS = 20
MIN_DOCS = 3
BITS_PER_LINE = 32
MAX_FILTER_BYTES = 64 << 20
_STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes, min_chars: int = MIN_CHARS) -> list[bytes | None]:
    """Key of each line: stripped, A-Z lower-cased; None where it is shorter
    than ``min_chars`` code points."""
    out: list[bytes | None] = []
    for line in text.lower().split(b"\n"):  # bytes.lower touches A-Z only
        key = line.strip(_STRIP)
        long = len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars)
        out.append(key if long else None)
    return out


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _hash_rows(min_chars: int):
    """Packed hashes of the distinct lines of each document row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [
                xxhash.xxh3_64_intdigest(k)
                for text in text_bytes(batch.column(0)) for k in {k for k in line_keys(text, min_chars) if k is not None}
            ]
            yield slice_rows(np.array(seen, np.uint64))

    return run


def twice_seen(docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, max_filter_bytes: int = MAX_FILTER_BYTES) -> BitFilter:
    """Builds the filter of lines that at least two documents may hold."""
    rows = cut_lineage(docs.select(F.col(text).alias("text")).mapInArrow(_hash_rows(min_chars), ROW_SCHEMA), "line-hashes")
    n = rows.agg(F.sum("n")).first()[0] or 0
    return build_filter(rows, n, BITS_PER_LINE, max_filter_bytes, repeated=True)


def _suspect_rows(shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                own = list({k for k in line_keys(text, min_chars) if k is not None})
                hit = shared.value.has(np.array([xxhash.xxh3_64_intdigest(k) for k in own], np.uint64)) if own else []
                for k in np.flatnonzero(hit):
                    ids.append(doc_id)
                    keys.append(_digest(own[k]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary())], ["doc_id", "key"])

    return run


def lost_lines(docs: DataFrame, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """(doc_id, lost): the digests of the lines that each document loses."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(twice_seen(docs, text, min_chars, max_filter_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where("doc_id IS NOT NULL").select("doc_id", F.col(text).alias("text"))
    found = named.mapInArrow(_suspect_rows(shared, min_chars), f"doc_id {kind}, key binary")
    pairs = cut_lineage(found.distinct(), "line-suspects")
    repeated = pairs.groupBy("key").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    # written, so that the join reads both sides from plain shuffles and a line
    # that very many documents hold can be split over tasks
    repeated = cut_lineage(repeated.select("key", "keeper"), "line-keepers")
    lost = pairs.join(repeated, "key").where("doc_id < keeper")
    return lost.groupBy("doc_id").agg(F.collect_list("key").alias("lost"))


def _without(text: pa.Array, lost: pa.Array, min_chars: pa.Array) -> pa.Array:
    n_lines, n_dropped, kept = [], [], []
    for body, gone, least in zip(text_bytes(text), lost.to_pylist(), min_chars.to_pylist(), strict=True):
        if gone:
            gone = set(gone)
            lines = body.split(b"\n")
            stay = [line for line, k in zip(lines, line_keys(body, least), strict=True) if k is None or _digest(k) not in gone]
            total, body = len(lines), b"\n".join(stay)
            n_dropped.append(total - len(stay))
        else:
            total = body.count(b"\n") + 1
            n_dropped.append(0)
        n_lines.append(total)
        kept.append(body)
    return pa.StructArray.from_arrays(
        [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
        ["n_lines", "n_dropped", "text"],
    )


def cleaned_lines(docs: DataFrame, into: str, text: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """``docs`` with a column ``into``: struct (n_lines, n_dropped, text)."""
    gone = fresh(docs, "lost")
    lost = lost_lines(docs, text, min_docs, min_chars, max_filter_bytes).withColumnRenamed("lost", gone)
    without = F.arrow_udf(_without, "struct<n_lines:long,n_dropped:long,text:string>")
    joined = docs.join(lost.hint("shuffle_hash"), "doc_id", "left")
    return joined.withColumn(into, without(F.col(text), F.col(gone), F.lit(min_chars))).select(*docs.columns, into)


def drop_repeated_lines(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the repeated lines gone from its texts; a text that is left
    without any line is empty. ``n_chars``, where there, is counted anew."""
    into = fresh(docs, "cleaned")
    out = cleaned_lines(docs, into, text, **options)
    changed = {text: F.col(f"{into}.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(f"{into}.text").cast(docs.schema["n_chars"].dataType)
    return out.withColumns(changed).select(*docs.columns)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) per document row."""
    out = cleaned_lines(docs.select("doc_id", "text"), "cleaned", **options)
    return out.select("doc_id", "cleaned.n_lines", "cleaned.n_dropped", F.sha2(F.col("cleaned.text").cast("binary"), 256).alias("kept_sha256"))
