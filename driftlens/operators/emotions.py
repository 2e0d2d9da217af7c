"""Affect scores per post: each distinct text is scored once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions import text as tx
from driftlens.functions.affect import compose_affect, lexicon_scores
from driftlens.operators.filters import POST_KEY
from driftlens.session import cut_lineage

Scorer = Callable[[Column], Column]
_SCORERS: dict[str, tuple[Scorer, str]] = {}


def register_scorer(name: str, scorer: Scorer, mode: str = "model") -> None:
    """Adds an affect engine: a function from a text Column to a STRUCT of the
    five scores. A pandas UDF or ``predict_batch_udf`` fits as is."""
    _SCORERS[name] = (scorer, mode)


register_scorer("lexicon-v1", lexicon_scores, "lexicon")


def _scored(texts: DataFrame, engine: str, scorer: Scorer | None) -> DataFrame:
    fn, mode = (scorer, "lexicon") if scorer is not None else _SCORERS[engine]
    return texts.withColumn("_a", compose_affect(fn(F.col("text")), mode)).select("text_key", "_a.*")


def _neutral_unless_scored() -> list[Column]:
    return [
        *[F.coalesce(a, F.lit(0.0)).alias(a) for a in fixed.AFFECT_DIMENSIONS],
        F.coalesce("neutral", F.lit(1.0)).alias("neutral"), F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"),
    ]


def score_texts(texts: DataFrame, engine: str = "lexicon-v1", scorer: Scorer | None = None) -> DataFrame:
    """``texts`` with scores in place of ``text``, row by row: for tables that hold
    each text about once, where grouping equal texts would shuffle all of them.
    Same scores as ``score_unique_then_join``."""
    others = [c for c in texts.columns if c != "text"]
    fn, mode = (scorer, "lexicon") if scorer is not None else _SCORERS[engine]
    d = texts.select(*others, tx.normalize_for_model(F.coalesce("text", F.lit(""))).alias("text"))
    d = d.withColumn("_a", compose_affect(fn(F.col("text")), mode)).select(*others, (F.col("text") != "").alias("_full"), "_a.*")
    scores = [c.name for c in d.schema if c.name not in (*others, "_full")]
    d = d.select(*others, "_full", *[F.when(F.col("_full"), F.col(c)).alias(c) for c in scores])
    version = F.when(F.col("_full"), engine).otherwise("none").alias("model_version")
    return d.select(*others, *_neutral_unless_scored(), version)


def score_unique_then_join(posts: DataFrame, engine: str = "lexicon-v1", scorer: Scorer | None = None,
                           cache: DataFrame | None = None) -> DataFrame:
    """(platform, post_id, five scores, neutral, sentiment, model_version).

    Texts that are equal after normalisation are scored once and joined back by
    their hash. ``cache`` (text_key, scores...) of an earlier run is anti-joined
    first, so only new texts reach the scorer. Empty texts get the neutral
    result.
    """
    raw = F.col("text_hash") if "text_hash" in posts.columns else F.md5(F.coalesce("text", F.lit("")))
    keyed = posts.select(*POST_KEY, raw.alias("text_hash"), "text")
    # equal raw texts collapse first, so only distinct ones are normalised
    texts = keyed.groupBy("text_hash").agg(F.min("text").alias("text"))
    normal = tx.normalize_for_model(F.coalesce("text", F.lit("")))
    texts = cut_lineage(texts.select("text_hash", normal.alias("text")).withColumn(
        "text_key", F.when(F.col("text") != "", F.md5("text"))), "texts")
    unique = texts.where("text_key IS NOT NULL").groupBy("text_key").agg(F.min("text").alias("text"))
    if cache is None:
        scores = _scored(unique, engine, scorer)
    else:
        fresh = _scored(unique.join(cache.select("text_key"), "text_key", "left_anti"), engine, scorer)
        scores = fresh.unionByName(cache.select(*fresh.columns))
    by_hash = texts.select("text_hash", "text_key").join(scores, "text_key", "left")
    d = keyed.select(*POST_KEY, "text_hash").join(by_hash, "text_hash")
    return d.select(
        *POST_KEY, *_neutral_unless_scored(),
        F.when(F.col("text_key").isNull(), "none").otherwise(engine).alias("model_version"),
    )
