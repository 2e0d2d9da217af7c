"""Audience statistics, released only as k-anonymous noisy cohorts.

Per-account cues exist inside these plans only; no function here returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import audience, fixed
from driftlens.functions.numeric import laplace_from_uniform, uniform_from_key
from driftlens.operators.filters import POST_KEY

DIMENSIONS = ["geography", "interests", "age", "language"]


def dominant_language(posts: DataFrame) -> DataFrame:
    """(platform, author_id, lang): most frequent known language, ties to the
    greater code."""
    counts = posts.where("lang IS NOT NULL").groupBy("platform", "author_id", "lang").agg(F.count("*").alias("n"))
    return counts.groupBy("platform", "author_id").agg(F.max_by("lang", F.struct("n", "lang")).alias("lang"))


def dimension_counts(accounts: DataFrame, posts: DataFrame, gazetteer: DataFrame, *, interests=None,
                     as_of_year: int, keep: str = "a-z&") -> DataFrame:
    """(dimension, bucket, n): accounts per bucket on four dimensions, unpivoted
    from one row per account and counted in one aggregate."""
    lang = dominant_language(posts).withColumnRenamed("author_id", "account_id")
    d = audience.infer_region(accounts, gazetteer, keep).join(lang, ["platform", "account_id"], "left")
    wide = d.select(
        F.coalesce("region", F.lit("unknown")).alias("geography"),
        audience.infer_interest(F.col("bio"), interests).alias("interests"),
        audience.infer_age_bracket(F.col("bio"), as_of_year).alias("age"),
        F.col("lang").alias("language"),
    )
    cells = ", ".join(f"'{c}', {c}" for c in DIMENSIONS)
    long = wide.selectExpr(f"stack({len(DIMENSIONS)}, {cells}) as (dimension, bucket)").where("bucket IS NOT NULL")
    return long.groupBy("dimension", "bucket").agg(F.count("*").alias("n"))


def noisy_count(n: Column, k: int, epsilon: float, seed: int | None, *key: Column) -> Column:
    """Rounded count with Laplace(1/epsilon) noise, never below k. The noise is
    a function of (key, seed), so a rerun releases the same value. Whoever knows
    the seed can subtract the noise, so there is no default: noise needs a secret
    seed."""
    if epsilon > 0 and seed is None:
        raise ValueError("noise needs a secret seed")
    noise = laplace_from_uniform(uniform_from_key(*key, F.lit(seed)), 1.0 / epsilon) if epsilon > 0 else F.lit(0.0)
    return F.greatest(F.lit(k), F.rint(n + noise)).cast("bigint")


def release_counts(counts: DataFrame, k: int = fixed.K_ANON, epsilon: float = fixed.EPSILON, seed: int | None = None,
                   keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(released, suppressed): buckets of at least k accounts with noisy counts,
    and per dimension the number of withheld buckets - never which."""
    group = [*keys, "dimension"]
    released = counts.where(F.col("n") >= k).select(
        *group, "bucket",
        noisy_count(F.col("n"), k, epsilon, seed, *[F.col(c).cast("string") for c in group], F.col("bucket")).alias("count"),
    )
    suppressed = counts.groupBy(*group).agg(F.count_if(F.col("n") < k).alias("suppressed_buckets"))
    return released, suppressed


def cohort_demographics(accounts: DataFrame, posts: DataFrame, gazetteer: DataFrame, flagged: DataFrame | None = None, *,
                        k: int = fixed.K_ANON, epsilon: float = fixed.EPSILON, seed: int | None = None, as_of_year: int,
                        interests=None, keep: str = "a-z&") -> tuple[DataFrame, DataFrame]:
    """Released cohorts over all accounts, or organic ones when ``flagged`` is
    given."""
    who = accounts
    if flagged is not None:
        who = accounts.join(flagged.select("platform", "account_id").distinct(), ["platform", "account_id"], "left_anti")
    counts = dimension_counts(who, posts, gazetteer, interests=interests, as_of_year=as_of_year, keep=keep)
    return release_counts(counts, k, epsilon, seed)


def topic_people(posts: DataFrame, assign: DataFrame, topic_id: int) -> DataFrame:
    """Posts of a topic UNION replies to them (platform, post_id, created_at,
    author_id): the people an audience is made of."""
    members = assign.where(F.col("topic_id") == topic_id).select(*POST_KEY)
    columns = ["platform", "post_id", "created_at", "author_id"]
    wrote = posts.join(members, POST_KEY, "left_semi").select(*columns)
    parents = members.withColumnRenamed("post_id", "parent_post_id")
    replied = posts.join(parents, ["platform", "parent_post_id"], "left_semi").select(*columns)
    return wrote.union(replied).distinct()


def topic_authors(posts: DataFrame, assign: DataFrame, topic_id: int) -> DataFrame:
    return topic_people(posts, assign, topic_id).select("platform", F.col("author_id").alias("account_id")).distinct()


def topic_audience(posts: DataFrame, accounts: DataFrame, assign: DataFrame, gazetteer: DataFrame, topic_id: int | None = None,
                   flagged: DataFrame | None = None, *, k: int = fixed.K_ANON, epsilon: float = fixed.EPSILON, seed: int | None = None,
                   as_of_year: int, interests=None, keep: str = "a-z&") -> dict[str, DataFrame]:
    """released, suppressed and a coverage row for one topic's people (or for
    everyone): accounts to the nearest ten or NULL under k, released states,
    date span."""
    who, span = accounts, posts
    if topic_id is not None:
        span = topic_people(posts, assign, topic_id)
        ids = span.select("platform", F.col("author_id").alias("account_id")).distinct()
        who = who.join(ids, ["platform", "account_id"], "left_semi")
    released, suppressed = cohort_demographics(who, posts, gazetteer, flagged, k=k, epsilon=epsilon, seed=seed,
                                               as_of_year=as_of_year, interests=interests, keep=keep)
    if flagged is not None:
        who = who.join(flagged.select("platform", "account_id").distinct(), ["platform", "account_id"], "left_anti")
    one = F.lit(1).alias("_k")
    n = who.agg(F.count("*").alias("n")).select(F.when(F.col("n") >= k, F.bround("n", -1)).alias("accounts"), one)
    states = released.agg(
        F.count_if((F.col("dimension") == "geography") & (F.col("bucket") != "unknown")).alias("states")
    ).withColumn("_k", F.lit(1))
    dates = span.agg(F.min("created_at").alias("from_ts"), F.max("created_at").alias("to_ts")).withColumn("_k", F.lit(1))
    return {"released": released, "suppressed": suppressed, "coverage": n.join(states, "_k").join(dates, "_k").drop("_k")}
