"""Filters, set predicates and paging over posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed

AUTHOR_KEY = ["platform", "author_id"]
POST_KEY = ["platform", "post_id"]


def flagged_accounts(coord_accounts: DataFrame, threshold: float = fixed.COORDINATED_SCORE) -> DataFrame:
    """Distinct (platform, account_id) with a coordination score >= threshold."""
    return coord_accounts.where(F.col("score") >= threshold).select("platform", "account_id").distinct()


def _as_authors(flagged: DataFrame) -> DataFrame:
    return flagged.select("platform", F.col("account_id").alias("author_id")).distinct()


def organic_only(posts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Posts whose author is not flagged."""
    return posts.join(_as_authors(flagged), AUTHOR_KEY, "left_anti")


def organic_flag(posts: DataFrame, flagged: DataFrame) -> DataFrame:
    """Posts plus ``is_coordinated`` for conditional counts in one pass."""
    marks = _as_authors(flagged).withColumn("_flag", F.lit(True))
    return posts.join(marks, AUTHOR_KEY, "left").withColumn(
        "is_coordinated", F.col("_flag").isNotNull()
    ).drop("_flag")


def filter_kind(posts: DataFrame, kind: str = "all") -> DataFrame:
    if kind == "all":
        return posts
    is_comment = F.col("kind").isin(fixed.COMMENT_KINDS)
    if kind == "comments":
        return posts.where(is_comment)
    if kind == "posts":
        return posts.where(~is_comment)
    raise ValueError(f"unknown kind {kind!r}")


def in_topic(posts: DataFrame, assign: DataFrame, topic_id: int) -> DataFrame:
    members = assign.where(F.col("topic_id") == topic_id).select(*POST_KEY)
    return posts.join(members, POST_KEY, "left_semi")


def since(edges: DataFrame, start) -> DataFrame:
    return edges.where(F.col("ts") >= F.lit(start).cast("timestamp"))


def min_threshold(df: DataFrame, column: str, minimum: float) -> DataFrame:
    return df.where(F.col(column) >= minimum)


def matches_all_terms(text: Column, terms: list[str]) -> Column:
    """All terms occur as whole words, case-insensitively."""
    from driftlens.operators.search import search_tokens

    words = search_tokens(text)
    ok = F.lit(True)
    for term in terms:
        ok = ok & F.array_contains(words, term.lower())
    return ok


def filter_posts(posts: DataFrame, *, assign: DataFrame | None = None, flagged: DataFrame | None = None,
                 platform: str | None = None, from_ts=None, to_ts=None, topic_id: int | None = None,
                 terms: list[str] | None = None, cursor=None, limit: int = 100) -> DataFrame:
    """Newest posts that pass every given filter (keyset cursor: older than)."""
    d = posts
    if platform is not None:
        d = d.where(F.col("platform") == platform)
    if from_ts is not None:
        d = d.where(F.col("created_at") >= F.lit(from_ts).cast("timestamp"))
    if to_ts is not None:
        d = d.where(F.col("created_at") <= F.lit(to_ts).cast("timestamp"))
    if cursor is not None:
        d = d.where(F.col("created_at") < F.lit(cursor).cast("timestamp"))
    if terms:
        d = d.where(matches_all_terms(F.col("text"), terms))
    if flagged is not None:
        d = organic_only(d, flagged)
    if topic_id is not None:
        d = in_topic(d, assign, topic_id)
    return d.orderBy(F.desc("created_at"), "platform", "post_id").limit(limit)


def page_posts(posts: DataFrame, cursor=None, limit: int = 100) -> DataFrame:
    """One page, newest first; the next cursor is the page's last created_at."""
    return filter_posts(posts, cursor=cursor, limit=min(limit, 500))


def orphan_replies(posts: DataFrame) -> DataFrame:
    """Count of posts whose parent was never collected."""
    parents = posts.select(F.col("post_id").alias("parent_post_id")).distinct()
    return (
        posts.where(F.col("parent_post_id").isNotNull())
        .join(parents, "parent_post_id", "left_anti")
        .agg(F.count("*").alias("orphan_replies"))
    )


def latest_across_sources(frames: list[DataFrame], limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Newest posts over several sources, and posts per platform of all of them."""
    union = frames[0]
    for f in frames[1:]:
        union = union.unionByName(f)
    newest = union.orderBy(F.desc("created_at"), "platform", "post_id").limit(limit)
    return newest, union.groupBy("platform").agg(F.count("*").alias("posts"))


def flagged_vs_truth(flagged: DataFrame, truth: DataFrame, key: str = "account_id") -> DataFrame:
    """|flagged ∩ truth|, |flagged \\ truth|, |truth \\ flagged| in one pass."""
    f = flagged.select(key).distinct().withColumn("f", F.lit(1))
    t = truth.select(key).distinct().withColumn("t", F.lit(1))
    return f.join(t, key, "full").agg(
        F.count_if(F.col("f").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"),
        F.count_if(F.col("f").isNull()).alias("fn"),
    )
