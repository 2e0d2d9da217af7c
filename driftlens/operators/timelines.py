"""Time series and per-platform views over posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.sequence import top_n_per_group
from driftlens.functions.time import epoch_seconds, time_bucket
from driftlens.operators.filters import POST_KEY, filter_kind, in_topic, organic_flag, organic_only

AFFECT = fixed.AFFECT_DIMENSIONS


def with_topic(posts: DataFrame, assign: DataFrame) -> DataFrame:
    """Posts that belong to a topic, with topic_id."""
    return posts.join(assign.select(*POST_KEY, "topic_id"), POST_KEY)


def with_emotions(posts: DataFrame, emotions: DataFrame, how: str = "left") -> DataFrame:
    return posts.join(emotions.select(*POST_KEY, *AFFECT), POST_KEY, how)


def topic_series(posts: DataFrame, assign: DataFrame, flagged: DataFrame) -> DataFrame:
    """Hourly posts per topic: all, and from accounts that are not flagged."""
    d = organic_flag(with_topic(posts, assign), flagged)
    return d.groupBy("topic_id", time_bucket(F.col("created_at")).alias("bucket_start")).agg(
        F.count("*").alias("count_all"), F.count_if(~F.col("is_coordinated")).alias("count_organic")
    )


def _affect_means() -> list[Column]:
    return [F.avg(a).alias(a) for a in AFFECT]


def emotion_timeline(posts: DataFrame, emotions: DataFrame, *, bucket: str = "1h",
                     flagged: DataFrame | None = None, assign: DataFrame | None = None,
                     topic_id: int | None = None, platform: str | None = None, kind: str = "all") -> DataFrame:
    """Mean of the five affects and n per bucket, under the given filters."""
    d = posts if platform is None else posts.where(F.col("platform") == platform)
    d = filter_kind(d, kind)
    if flagged is not None:
        d = organic_only(d, flagged)
    if topic_id is not None:
        d = in_topic(d, assign, topic_id)
    return with_emotions(d, emotions, "inner").groupBy(
        time_bucket(F.col("created_at"), bucket).alias("bucket")
    ).agg(*_affect_means(), F.count("*").alias("n"))


def volume_timeline(posts: DataFrame, flagged: DataFrame, bucket: str = "1h") -> DataFrame:
    return organic_flag(posts, flagged).groupBy(
        time_bucket(F.col("created_at"), bucket).alias("bucket"), "platform"
    ).agg(F.count("*").alias("n"), F.count_if("is_coordinated").alias("coordinated"))


def compare_raw_organic(posts: DataFrame, emotions: DataFrame, flagged: DataFrame) -> DataFrame:
    """The five means over all posts and over organic posts: two rows from one
    pass, unpivoted from a single aggregate row."""
    d = organic_flag(with_emotions(posts, emotions, "inner"), flagged)
    organic = ~F.col("is_coordinated")
    wide = d.agg(
        *[F.avg(a).alias(f"raw_{a}") for a in AFFECT],
        *[F.avg(F.when(organic, F.col(a))).alias(f"org_{a}") for a in AFFECT],
        F.count("*").alias("raw_n"), F.count_if(organic).alias("org_n"),
    )
    cells = ", ".join(
        f"'{label}', " + ", ".join(f"{p}_{c}" for c in [*AFFECT, "n"])
        for label, p in (("raw", "raw"), ("organic", "org"))
    )
    return wide.selectExpr(f"stack(2, {cells}) as (view, {', '.join(AFFECT)}, n)")


def platform_summary(posts: DataFrame, flagged: DataFrame) -> DataFrame:
    return organic_flag(posts, flagged).groupBy("platform").agg(
        F.count("*").alias("posts"),
        F.countDistinct("author_id").alias("accounts"),
        F.count_if(F.col("kind").isin(fixed.COMMENT_KINDS)).alias("comments"),
        F.count_if(F.col("kind") == "repost").alias("reposts"),
        F.round(F.avg(F.col("is_coordinated").cast("double")), 4).alias("coordinated_share"),
        F.min("created_at").alias("first_post"),
        F.max("created_at").alias("last_post"),
    )


def platform_topics(posts: DataFrame, assign: DataFrame, n: int = 6) -> DataFrame:
    """Largest topics of every platform."""
    counts = with_topic(posts, assign).groupBy("platform", "topic_id").agg(F.count("*").alias("n"))
    return top_n_per_group(counts, ["platform"], [F.desc("n"), F.col("topic_id")], n)


def platform_accounts(posts: DataFrame, flagged: DataFrame, n: int = 8) -> DataFrame:
    """Most active accounts of every platform with the replies they received.

    Replies are counted for the kept accounts only: their posts are selected
    first, then matched by parent id in one join for all of them.
    """
    counts = organic_flag(posts, flagged).groupBy("platform", F.col("author_id").alias("account_id")).agg(
        F.count("*").alias("posts"), F.max("is_coordinated").alias("coordinated")
    )
    top = top_n_per_group(counts, ["platform"], [F.desc("posts"), F.col("account_id")], n)
    theirs = posts.select("platform", F.col("author_id").alias("account_id"), F.col("post_id").alias("parent_post_id"))
    theirs = theirs.join(top.select("platform", "account_id"), ["platform", "account_id"], "left_semi")
    replies = (
        posts.where(F.col("parent_post_id").isNotNull())
        .groupBy("platform", "parent_post_id").agg(F.count("*").alias("_n"))
        .join(theirs, ["platform", "parent_post_id"])
        .groupBy("platform", "account_id").agg(F.sum("_n").alias("replies_received"))
    )
    return top.join(replies, ["platform", "account_id"], "left").fillna(0, ["replies_received"])


def platform_affect(posts: DataFrame, emotions: DataFrame) -> DataFrame:
    return with_emotions(posts, emotions, "inner").groupBy("platform").agg(*_affect_means(), F.count("*").alias("n"))


def platform_recent(posts: DataFrame, n: int = 6) -> DataFrame:
    slim = posts.select("platform", "post_id", "author_id", "kind", "text", "created_at")
    return top_n_per_group(slim, ["platform"], [F.desc("created_at"), F.col("post_id")], n)


def platform_kinds(posts: DataFrame) -> DataFrame:
    return posts.groupBy("platform", "kind").agg(F.count("*").alias("n"))


def platform_detail(posts: DataFrame, assign: DataFrame, emotions: DataFrame, flagged: DataFrame,
                    platform: str) -> dict[str, DataFrame]:
    d = posts.where(F.col("platform") == platform)
    return {
        "topics": platform_topics(d, assign),
        "accounts": platform_accounts(d, flagged),
        "emotions": platform_affect(d, emotions),
        "recent": platform_recent(d),
        "kinds": platform_kinds(d),
    }


def span_hours(posts: DataFrame) -> float:
    """Hours between the first and the last post, at least 1."""
    lo, hi = posts.agg(F.min(epoch_seconds(F.col("created_at"))), F.max(epoch_seconds(F.col("created_at")))).first()
    return 1.0 if lo is None else max(1.0, (hi - lo) / 3600.0)


def hashtag_counts(posts: DataFrame, tags: str = "hashtags") -> DataFrame:
    """Posts per (tag, hour, platform); a tag counts once per post. Partial
    aggregation keeps a tag used by most posts cheap."""
    tag = F.explode(F.array_distinct(F.transform(tags, lambda t: F.lower(t)))).alias("keyword")
    return posts.select(tag, time_bucket(F.col("created_at")).alias("hour"), "platform").groupBy(
        "keyword", "hour", "platform"
    ).agg(F.count("*").alias("n"))


def trending_hashtags(posts: DataFrame, tags: str = "hashtags", limit: int = 12,
                      min_peak: int = 10) -> tuple[DataFrame, DataFrame]:
    """(viral, top): tags by spike over their usual hourly rate, and by posts."""
    hours = span_hours(posts)
    counts = hashtag_counts(posts, tags)
    hourly = counts.groupBy("keyword", "hour").agg(F.sum("n").alias("n"))
    totals = hourly.groupBy("keyword").agg(
        F.sum("n").alias("posts"), F.max("n").alias("peak_per_hour"),
        F.max_by("hour", F.struct("n", -F.unix_seconds("hour"))).alias("peak_at"),
    )
    by_platform = counts.groupBy("keyword", "platform").agg(F.sum("n").alias("n"))
    ranked = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "platform"))), 1, 3)
    platforms = by_platform.groupBy("keyword").agg(F.transform(ranked, lambda x: x["platform"]).alias("platforms"))
    usual = F.col("posts") / F.lit(hours)
    rows = totals.join(platforms, "keyword").withColumns({
        "usual_per_hour": F.round(usual, 2),
        "spike": F.round(F.col("peak_per_hour") / F.greatest(usual, F.lit(1.0)), 1),
    })
    viral = rows.where(F.col("peak_per_hour") >= min_peak).orderBy(F.desc("spike"), F.desc("posts"), "keyword").limit(limit)
    return viral, rows.orderBy(F.desc("posts"), "keyword").limit(limit)


def spread_frames(posts: DataFrame, assign: DataFrame, topic_id: int | None = None,
                  max_frames: int = 48) -> DataFrame:
    """Cumulative posts, accounts and per-platform posts by hour, last frames.

    Everything is reduced to one row per (topic, hour) before any running sum,
    so the ordered window only ever sees hours. An account counts in the hour
    of its first post.
    """
    chosen = assign if topic_id is None else assign.where(F.col("topic_id") == topic_id)
    d = with_topic(posts, chosen).select(
        "topic_id", "platform", "author_id", time_bucket(F.col("created_at")).alias("hour")
    )
    hourly = d.groupBy("topic_id", "hour").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("platform") == p).alias(f"n_{p}") for p in fixed.PLATFORMS],
    )
    firsts = (
        d.groupBy("topic_id", "author_id").agg(F.min("hour").alias("hour"))
        .groupBy("topic_id", "hour").agg(F.count("*").alias("new_accounts"))
    )
    running = Window.partitionBy("topic_id").orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    cum = hourly.join(firsts, ["topic_id", "hour"], "left").select(
        "topic_id", "hour", F.sum("n").over(running).alias("posts"),
        F.coalesce(F.sum("new_accounts").over(running), F.lit(0)).alias("accounts"),
        *[F.sum(f"n_{p}").over(running).alias(f"c_{p}") for p in fixed.PLATFORMS],
    )
    pairs = F.array(*[F.struct(F.lit(p).alias("k"), F.col(f"c_{p}").alias("v")) for p in fixed.PLATFORMS])
    frames = cum.select(
        "topic_id", "hour", "posts", "accounts",
        F.map_from_entries(F.filter(pairs, lambda x: x["v"] > 0)).alias("platforms"),
    )
    return top_n_per_group(frames, ["topic_id"], [F.desc("hour")], max_frames).drop("rank")


def feed_summary(posts: DataFrame, hashtags: str = "hashtags", terms: int = 8) -> dict[str, DataFrame]:
    """Counts of a feed (with ``sector`` and ``anxiety`` columns): totals, top
    hashtags, top words and sectors. ``top_terms`` takes tags when there are any."""
    totals = posts.agg(F.count("*").alias("posts"), F.round(F.avg("anxiety"), 3).alias("anxiety"))
    tag = posts.select(F.explode(F.transform(hashtags, lambda t: F.lower(t))).alias("term"))
    words = F.filter(
        F.regexp_extract_all(F.col("text"), F.lit(r"[A-Za-z][A-Za-z'-]{3,}"), F.lit(0)),
        lambda w: ~F.lower(w).isin(fixed.FEED_STOPWORDS),
    )
    word = posts.select(F.explode(F.transform(words, lambda w: F.lower(w))).alias("term"))

    def top(d: DataFrame) -> DataFrame:
        return d.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(terms)

    tags, plain = top(tag).withColumn("source", F.lit("hashtag")), top(word).withColumn("source", F.lit("word"))
    both = Window.partitionBy(F.lit(1))  # at most 2 * terms rows
    tagged = F.max(F.col("source") == "hashtag").over(both)
    chosen = tags.unionByName(plain).withColumn("_any_tag", tagged).where(
        (F.col("source") == "hashtag") | ~F.col("_any_tag")
    ).drop("_any_tag")
    return {
        "totals": totals, "hashtags": tags, "words": plain, "top_terms": chosen,
        "sectors": posts.groupBy("sector").agg(F.count("*").alias("posts")),
    }
