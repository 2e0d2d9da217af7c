"""SQL names for the library's functions, and pluggable embedders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlens.operators.links import hash_embed

Embedder = Callable[[DataFrame, str], DataFrame]
_EMBEDDERS: dict[str, Embedder] = {"hashing": lambda texts, key: hash_embed(texts, key)}


def register_embedder(name: str, embedder: Embedder) -> None:
    """Adds an embedder: (texts(key, text), key) -> (key, vector ARRAY<FLOAT>)."""
    _EMBEDDERS[name] = embedder


def embed(texts: DataFrame, key: str, engine: str = "hashing") -> DataFrame:
    """Vectors of each distinct normalised text, by the named engine."""
    return _EMBEDDERS[engine](texts, key)


BINS = 12
DAY_S = 86_400
_SQL = {
    # how regular gaps are, from aggregates that combine map-side
    "burstiness": (
        "n BIGINT, mean DOUBLE, sd DOUBLE", "DOUBLE",
        "CASE WHEN n < 2 OR sd + mean <= 0 THEN 0.0D ELSE (sd - mean) / (sd + mean) END",
    ),
    "gap_bin": (
        "gap DOUBLE", "INT",
        f"least(CAST(floor({BINS} * log10(least(greatest(gap, 1.0D), {DAY_S}.0D)) / log10({DAY_S}.0D)) AS INT), {BINS - 1})",
    ),
    "gap_entropy": (
        "counts ARRAY<BIGINT>", "DOUBLE",
        "CASE WHEN aggregate(counts, 0L, (a, c) -> a + c) < 2 THEN 1.0D ELSE aggregate(filter(counts, c -> c > 0), 0.0D,"
        " (a, c) -> a - c / aggregate(counts, 0L, (x, y) -> x + y) * log2(c / aggregate(counts, 0L, (x, y) -> x + y)))"
        f" / log2({BINS}.0D) END",
    ),
}


def register_functions(spark: SparkSession) -> None:
    """SQL functions over built-in aggregates: ``burstiness(count(gap), avg(gap),
    stddev_pop(gap))``, ``gap_bin(gap)``, and ``gap_entropy(counts)`` over the
    number of gaps in each bin. No group is ever gathered for them."""
    for name, (arguments, kind, body) in _SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
