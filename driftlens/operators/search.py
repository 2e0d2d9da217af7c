"""Full-text search: postings as a table, BM25 as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def search_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))


def postings(posts: DataFrame) -> DataFrame:
    """(platform, post_id, doc_len, term, tf). One row per distinct term of a
    post; the build of an index is this frame written partitioned by term."""
    tokens = posts.select("platform", "post_id", search_tokens(F.col("text")).alias("w"))
    return (
        tokens.select("platform", "post_id", F.size("w").alias("doc_len"), F.explode("w").alias("term"))
        .groupBy("platform", "post_id", "doc_len", "term")
        .agg(F.count("*").alias("tf"))
    )


def _occurrences(term: str) -> Column:
    return F.size(F.filter("w", lambda x: x == term))


def search_bm25(posts: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75,
                limit: int = 20) -> DataFrame:
    """Posts with every term, best BM25 first (limit at most 200).

    Term counts come straight from the token array, so nothing is exploded and
    only (key, doc_len, tf...) leaves the scan. The rank is negative: smaller
    is better, as in the usual full-text convention.
    """
    terms = list(dict.fromkeys(t.lower().strip("#@") for t in terms))
    tokens = posts.select("platform", "post_id", search_tokens(F.col("text")).alias("w"))
    counted = tokens.select(
        "platform", "post_id", F.size("w").alias("doc_len"),
        *[_occurrences(t).alias(f"tf{i}") for i, t in enumerate(terms)],
    )
    stats = counted.agg(
        F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"),
        *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))],
    ).first()
    score = F.lit(0.0)
    hit = F.lit(True)
    for i in range(len(terms)):
        tf = F.col(f"tf{i}").cast("double")
        idf_value = (stats["n_docs"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5)
        idf = F.greatest(F.log(F.lit(float(idf_value))), F.lit(1e-6))
        length = 1.0 - b + b * F.col("doc_len") / F.lit(float(stats["avg_len"] or 1.0))
        score = score + idf * tf * (k1 + 1.0) / (tf + k1 * length)
        hit = hit & (F.col(f"tf{i}") > 0)
    ranked = counted.where(hit).select("platform", "post_id", (-score).alias("rank"))
    return ranked.orderBy("rank", "platform", "post_id").limit(min(limit, 200))
