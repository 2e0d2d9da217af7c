"""Coordinated posting: narrative clusters, cluster scores, account scores.

Scores are statistical signals for human review, not accusations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions import text as tx
from driftlens.functions.numeric import logistic, weighted_sum
from driftlens.functions.sequence import top_n_per_group, with_previous
from driftlens.functions.time import epoch_seconds, slot, time_bucket
from driftlens.operators.filters import POST_KEY
from driftlens.operators.gaps import exact_median, gap_statistics, inter_post_gaps
from driftlens.operators.links import connected_components, star_links, text_groups
from driftlens.session import cut_lineage


def post_node(platform: str = "platform", post_id: str = "post_id") -> Column:
    return F.concat_ws(":", F.col(platform), F.col(post_id))


def with_text_group(posts: DataFrame, groups: DataFrame) -> DataFrame:
    """Posts plus ``text_group`` from a (text_key, text_group) table."""
    keyed = posts if "text_key" in posts.columns else posts.withColumn("text_key", tx.duplicate_key(F.col("text")))
    return keyed.join(groups, "text_key")


def narrative_links(posts: DataFrame, *, tags: str | None = None,
                    text_slot: int = fixed.TEXT_SLOT_SECONDS, tag_slot: int = fixed.HASHTAG_SLOT_SECONDS,
                    use: tuple[str, ...] = ("text", "tag", "origin")) -> DataFrame:
    """(src, dst) links between posts that share a near-duplicate text group in
    the same clock slot, any hashtag in the same slot, or an origin post.

    ``posts`` needs text_group. Members of a key link to the key's first post,
    so the number of links is linear in posts. ``tags`` names an array column;
    by default hashtags are read from the text.
    """
    d = posts.withColumn("node", post_node())
    links = []
    if "text" in use:
        key = F.concat_ws("|", F.lit("text"), "text_group", slot(F.col("created_at"), text_slot).cast("string"))
        links.append(star_links(d.select("node", key.alias("link_key")), "link_key", "node"))
    if "tag" in use:
        found = F.col(tags) if tags else F.regexp_extract_all(F.col("text"), F.lit(r"(?U)#\w+"), F.lit(0))
        tag = F.explode(F.array_distinct(F.transform(found, lambda t: F.lower(t)))).alias("tag")
        tagged = d.select("node", tag, slot(F.col("created_at"), tag_slot).cast("string").alias("half"))
        key = F.concat_ws("|", F.lit("tag"), "tag", "half")
        links.append(star_links(tagged.select("node", key.alias("link_key")), "link_key", "node"))
    if "origin" in use:
        targets = d.groupBy("post_id").agg(F.min("node").alias("dst"))
        origin = d.where(F.col("origin_post_id").isNotNull()).select(
            F.col("node").alias("src"), F.col("origin_post_id").alias("post_id")
        )
        links.append(origin.join(targets, "post_id").select("src", "dst").where("src != dst"))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def narrative_clusters(posts: DataFrame, links: DataFrame, min_posts: int = fixed.MIN_CLUSTER_POSTS) -> DataFrame:
    """(platform, post_id, cluster): components of the links with enough posts."""
    comp = connected_components(links)
    sizes = comp.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= min_posts)
    big = comp.join(sizes.select("component"), "component").select(F.col("component").alias("cluster"), "node")
    return posts.select(*POST_KEY, post_node().alias("node")).join(big, "node").select(*POST_KEY, "cluster")


def cross_account_duplicates(d: DataFrame) -> DataFrame:
    """(cluster, dup_ratio): share of posts whose text group was also used by
    another author of the cluster. Input: cluster, author_id, text_group."""
    used = d.groupBy("cluster", "text_group").agg(
        F.count("*").alias("n"), F.countDistinct("author_id").alias("authors")
    )
    return used.groupBy("cluster").agg(
        (F.sum(F.when(F.col("authors") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("dup_ratio")
    )


def has_sync_partner(d: DataFrame, keys: list[str], seconds: int = fixed.SYNC_SECONDS) -> DataFrame:
    """``d`` plus ``has_partner``: another author posted within ``seconds`` under
    the same keys.

    A range self join would emit every pair of a hot minute. Instead each
    (keys, slot of ``seconds``) keeps only its first two and last two posts by
    different authors: two authors in one slot are always in range, and for the
    neighbouring slots the nearest post by somebody else decides.
    """
    from pyspark.sql import Window

    t = d.withColumn("_t", F.unix_micros("created_at")).withColumn("_slot", slot(F.col("created_at"), seconds))
    ends = t.groupBy(*keys, "_slot", "author_id").agg(F.min("_t").alias("lo"), F.max("_t").alias("hi"))

    def two(order: list[Column], column: str) -> DataFrame:
        best = top_n_per_group(ends, [*keys, "_slot"], order, 2)
        return best.groupBy(*keys, "_slot").agg(
            F.max(F.when(F.col("rank") == 1, F.col("author_id"))).alias(f"{column}_author"),
            F.max(F.when(F.col("rank") == 1, F.col(column))).alias(f"{column}_1"),
            F.max(F.when(F.col("rank") == 2, F.col(column))).alias(f"{column}_2"),
        )

    summary = two([F.col("lo"), F.col("author_id")], "lo").join(
        two([F.desc("hi"), F.col("author_id")], "hi"), [*keys, "_slot"]
    )
    w = Window.partitionBy(*keys).orderBy("_slot")  # one row per slot in use
    near_next = F.lead("_slot").over(w) == F.col("_slot") + 1
    near_prev = F.lag("_slot").over(w) == F.col("_slot") - 1
    summary = summary.select(
        *keys, "_slot", F.col("lo_2").isNotNull().alias("_shared"),
        *[F.when(near_next, F.lead(c).over(w)).alias(f"next_{c}") for c in ("lo_author", "lo_1", "lo_2")],
        *[F.when(near_prev, F.lag(c).over(w)).alias(f"prev_{c}") for c in ("hi_author", "hi_1", "hi_2")],
    )
    span = seconds * 1_000_000
    me = F.col("author_id")
    ahead = F.when(F.col("next_lo_author") != me, F.col("next_lo_1")).otherwise(F.col("next_lo_2"))
    behind = F.when(F.col("prev_hi_author") != me, F.col("prev_hi_1")).otherwise(F.col("prev_hi_2"))
    hit = (
        F.col("_shared")
        | F.coalesce(ahead - F.col("_t") <= span, F.lit(False))
        | F.coalesce(F.col("_t") - behind <= span, F.lit(False))
    )
    return t.join(summary, [*keys, "_slot"]).select(*d.columns, hit.alias("has_partner"))


def co_sync(posts: DataFrame, clusters: DataFrame, seconds: int = fixed.SYNC_SECONDS) -> DataFrame:
    """(cluster, account_id, co_sync): share of an account's posts with a
    near-duplicate by another author within ``seconds``."""
    d = posts.join(clusters, POST_KEY).select("cluster", "author_id", "text_group", "created_at")
    return has_sync_partner(d, ["cluster", "text_group"], seconds).groupBy(
        "cluster", F.col("author_id").alias("account_id")
    ).agg(F.avg(F.col("has_partner").cast("double")).alias("co_sync"))


def account_regularity(d: DataFrame) -> DataFrame:
    """(cluster, author_id, n_posts, regularity) of own gaps; 0 under 3 posts."""
    gaps = inter_post_gaps(d, ["cluster", "author_id"])
    stats = gap_statistics(gaps, ["cluster", "author_id"])
    regular = F.when(F.col("n_posts") >= 3, F.greatest(F.lit(0.0), -F.col("burstiness"))).otherwise(0.0)
    return stats.select("cluster", "author_id", "n_posts", regular.alias("regularity"))


def cluster_features(posts: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row per cluster with the five scored features."""
    d = posts.join(clusters, POST_KEY)
    stats = gap_statistics(inter_post_gaps(d, ["cluster"], order=["created_at", "platform", "post_id"],
                                           slot_seconds=3600), ["cluster"])
    accounts = account_regularity(d)
    regular = accounts.groupBy("cluster").agg(
        F.count("*").alias("n_accounts"),
        (F.sum(F.when(F.col("regularity") >= fixed.REGULAR_CADENCE, F.col("n_posts")).otherwise(0))
         / F.sum("n_posts")).alias("regular_share"),
    )
    return (
        stats.join(cross_account_duplicates(d), "cluster").join(regular, "cluster")
        .select("cluster", "n_posts", "n_accounts", F.col("gap_entropy").alias("hn"), "burstiness",
                F.col("synchrony").alias("sync"), "dup_ratio", "regular_share")
    )


def cluster_parts() -> dict[str, Column]:
    """The weighted terms of the cluster score."""
    return {
        "sync": F.col("sync"), "concentration": 1.0 - F.col("hn"),
        "regularity": F.greatest(F.lit(0.0), -F.col("burstiness")),
        "dup_ratio": F.col("dup_ratio"), "regular_share": F.col("regular_share"),
    }


def score_clusters(features: DataFrame, weights: dict[str, float] | None = None, bias: float = fixed.CLUSTER_BIAS,
                   min_accounts: int = fixed.MIN_CLUSTER_ACCOUNTS, threshold: float = fixed.COORDINATED_SCORE) -> DataFrame:
    weights = fixed.CLUSTER_WEIGHTS if weights is None else weights
    scored = features.where(F.col("n_accounts") >= min_accounts).withColumn(
        "score", logistic(weighted_sum(weights, cluster_parts()) - bias)
    )
    return scored.where(F.col("score") >= threshold)


def account_features(posts: DataFrame, clusters: DataFrame, dup: DataFrame,
                     seconds: int = fixed.SYNC_SECONDS) -> DataFrame:
    """(cluster, account_id, co_sync, regularity, repetition, cluster_dup, n_posts)."""
    d = posts.join(clusters, POST_KEY)
    regular = account_regularity(d).withColumnRenamed("author_id", "account_id")
    return (
        co_sync(posts, clusters, seconds).join(regular, ["cluster", "account_id"])
        .join(dup.select("cluster", F.col("dup_ratio").alias("cluster_dup")), "cluster")
        .withColumn("repetition", F.least(F.lit(1.0), (F.col("n_posts") - 1) / 3.0))
    )


def score_accounts(features: DataFrame, weights: dict[str, float] | None = None,
                   bias: float = fixed.ACCOUNT_BIAS) -> DataFrame:
    weights = fixed.ACCOUNT_WEIGHTS if weights is None else weights
    return features.withColumn("score", logistic(weighted_sum(weights) - bias))


def mode_topic(posts: DataFrame, clusters: DataFrame, assign: DataFrame) -> DataFrame:
    """(cluster, topic_id): most common topic, smallest id on a tie."""
    d = clusters.join(assign.select(*POST_KEY, "topic_id"), POST_KEY)
    counts = d.groupBy("cluster", "topic_id").agg(F.count("*").alias("n"))
    return counts.groupBy("cluster").agg(F.max_by("topic_id", F.struct("n", -F.col("topic_id"))).alias("topic_id"))


def run_coordination(posts: DataFrame, assign: DataFrame, *, min_sim: float | None = fixed.DUPLICATE_SIMILARITY,
                     groups: DataFrame | None = None, tags: str | None = None, embedder=None,
                     text_slot: int = fixed.TEXT_SLOT_SECONDS, tag_slot: int = fixed.HASHTAG_SLOT_SECONDS,
                     use: tuple[str, ...] = ("text", "tag", "origin"),
                     min_posts: int = fixed.MIN_CLUSTER_POSTS, min_accounts: int = fixed.MIN_CLUSTER_ACCOUNTS,
                     threshold: float = fixed.COORDINATED_SCORE) -> tuple[DataFrame, DataFrame]:
    """(coord_clusters, coord_accounts): the whole two-stage detector.

    Accounts get one row per platform they used inside the cluster; ``reasons``
    holds every feature behind the score.
    """
    written = posts.where(F.col("text") != "")
    if groups is None:
        groups = text_groups(written, min_sim, embedder)
    slim = cut_lineage(
        with_text_group(written, groups).select(
            *POST_KEY, "author_id", "created_at", "origin_post_id", "text_group",
            *([tags] if tags else ["text"] if "tag" in use else []),
        ), "grouped",
    )
    clusters = cut_lineage(
        narrative_clusters(slim, narrative_links(slim, tags=tags, text_slot=text_slot, tag_slot=tag_slot, use=use),
                           min_posts), "clusters",
    )
    features = cut_lineage(cluster_features(slim, clusters), "features")
    scored = score_clusters(features, min_accounts=min_accounts, threshold=threshold)
    coord_clusters = cut_lineage(scored.join(mode_topic(slim, clusters, assign), "cluster", "left"), "coord")
    kept = clusters.join(coord_clusters.select("cluster"), "cluster", "left_semi")
    accounts = score_accounts(account_features(slim, kept, coord_clusters))
    used = slim.join(kept, POST_KEY).select("cluster", "platform", F.col("author_id").alias("account_id")).distinct()
    reasons = coord_clusters.select(
        "cluster", F.col("score").alias("cluster_score"), F.col("hn").alias("cluster_hn"),
        F.col("burstiness").alias("cluster_burstiness"), F.col("sync").alias("cluster_sync"),
    )
    names = ["co_sync", "regularity", "repetition", "cluster_dup", "n_posts",
             "cluster_score", "cluster_hn", "cluster_burstiness", "cluster_sync"]
    coord_accounts = (
        used.join(accounts, ["cluster", "account_id"]).join(reasons, "cluster")
        .select("platform", "account_id", "cluster", "score",
                F.struct(*[F.round(F.col(c).cast("double"), 4).alias(c) for c in names]).alias("reasons"))
    )
    return coord_clusters, coord_accounts


# -- views over the results --------------------------------------------------
def cluster_list(coord_clusters: DataFrame, coord_accounts: DataFrame, topics: DataFrame | None = None,
                 threshold: float = fixed.COORDINATED_SCORE, limit: int = 50) -> DataFrame:
    n = coord_accounts.groupBy("cluster").agg(
        F.countDistinct(F.when(F.col("score") >= threshold, F.col("account_id"))).alias("n_coordinated")
    )
    d = coord_clusters.join(n, "cluster", "left").fillna(0, ["n_coordinated"])
    if topics is not None:
        d = d.join(topics.select("topic_id", F.col("label").alias("topic_label")), "topic_id", "left")
    return d.orderBy(F.desc("score"), "cluster").limit(limit)


def cluster_accounts(coord_accounts: DataFrame) -> DataFrame:
    """Accounts of every cluster: platforms used, best score and its reasons."""
    return coord_accounts.groupBy("cluster", "account_id").agg(
        F.sort_array(F.collect_set("platform")).alias("platforms"),
        F.max("score").alias("score"), F.max_by("reasons", F.struct("score", "platform")).alias("reasons"),
    )


def cluster_timing(posts: DataFrame, assign: DataFrame, coord_clusters: DataFrame, coord_accounts: DataFrame,
                   threshold: float = fixed.COORDINATED_SCORE) -> DataFrame:
    """Posts per minute in each cluster's topic, coordinated and other."""
    d = posts.join(assign.select(*POST_KEY, "topic_id"), POST_KEY).join(
        coord_clusters.where(F.col("topic_id").isNotNull()).select("cluster", "topic_id"), "topic_id"
    )
    marks = coord_accounts.groupBy("cluster", "platform", F.col("account_id").alias("author_id")).agg(
        (F.max("score") >= threshold).alias("_flag")
    )
    flagged = F.coalesce("_flag", F.lit(False))
    return d.join(marks, ["cluster", "platform", "author_id"], "left").groupBy(
        "cluster", time_bucket(F.col("created_at"), "1m").alias("minute")
    ).agg(F.count_if(flagged).alias("coordinated"), F.count_if(~flagged).alias("other"))


def cluster_evidence(posts: DataFrame, assign: DataFrame, coord_clusters: DataFrame, coord_accounts: DataFrame,
                     threshold: float = fixed.COORDINATED_SCORE, n: int = 25) -> DataFrame:
    """First posts of each cluster's flagged accounts in its topic."""
    who = coord_accounts.where(F.col("score") >= threshold).select(
        "cluster", "platform", F.col("account_id").alias("author_id")
    ).distinct()
    d = posts.join(assign.select(*POST_KEY, "topic_id"), POST_KEY).join(who, ["platform", "author_id"]).join(
        coord_clusters.select("cluster", "topic_id"), ["cluster", "topic_id"]
    )
    return top_n_per_group(d, ["cluster"], [F.col("created_at"), F.col("platform"), F.col("post_id")], n)


def synchrony_fingerprint(posts: DataFrame, assign: DataFrame, coord_accounts: DataFrame, cluster, topic_id: int,
                          threshold: float = fixed.COORDINATED_SCORE, min_organic: int = 10,
                          fallback: int = 400, seconds: int = fixed.SYNC_SECONDS) -> dict[str, DataFrame]:
    """Timing of a cluster's flagged accounts next to ordinary posters of its
    topic in the window from 30 minutes before to 60 minutes after.

    With fewer than ``min_organic`` ordinary posts in the window, the topic's
    first ``fallback`` ordinary posts are compared instead. ``stats`` has one
    row per group; ``times`` lists the post times of the most active accounts.
    """
    d = posts.join(assign.where(F.col("topic_id") == topic_id).select(*POST_KEY), POST_KEY, "left_semi")
    d = d.select("platform", "post_id", "author_id", "created_at")
    strong = coord_accounts.where(F.col("score") >= threshold)
    members = strong.where(F.col("cluster") == cluster).select("platform", F.col("account_id").alias("author_id"))
    flagged = d.join(members.distinct(), ["platform", "author_id"], "left_semi")
    ordinary = d.join(strong.select(F.col("account_id").alias("author_id")).distinct(), "author_id", "left_anti")
    start, end = flagged.agg(F.min("created_at"), F.max("created_at")).first()
    window = ordinary.where(
        (F.col("created_at") >= F.lit(start) - F.expr("INTERVAL 30 MINUTES"))
        & (F.col("created_at") <= F.lit(end) + F.expr("INTERVAL 60 MINUTES"))
    )
    if window.limit(min_organic).count() < min_organic:
        window = ordinary.orderBy("created_at", "post_id").limit(fallback)
    columns = ["platform", "post_id", "author_id", "created_at"]
    both = flagged.select(*columns).withColumn("group", F.lit("flagged")).unionByName(
        window.select(*columns).withColumn("group", F.lit("organic"))
    )
    both = cut_lineage(both, "fingerprint")
    return {"stats": fingerprint_stats(both, seconds), "times": fingerprint_times(both)}


def fingerprint_stats(both: DataFrame, seconds: int = fixed.SYNC_SECONDS) -> DataFrame:
    counts = both.groupBy("group").agg(F.count("*").alias("posts"), F.countDistinct("author_id").alias("accounts"))
    own = inter_post_gaps(both, ["group", "author_id"])
    median = exact_median(own, ["group"], "gap_s").select("group", F.rint("median").cast("bigint").alias("median_gap_s"))
    stream = with_previous(both, ["group"], ["created_at", "post_id"], slot(F.col("created_at"), 3600),
                           {"_ts": "created_at", "_who": "author_id"})
    close = (epoch_seconds(F.col("created_at")) - epoch_seconds(F.col("_ts")) <= seconds) & (
        F.col("author_id") != F.col("_who")
    )
    near = stream.groupBy("group").agg(F.count_if(close).alias("_near"))
    return counts.join(median, "group", "left").join(near, "group").select(
        "group", "posts", "accounts", "median_gap_s",
        F.round(F.col("_near") / F.greatest(F.lit(1), F.col("posts") - 1), 3).alias("within_window"),
    )


def fingerprint_times(both: DataFrame, flagged_accounts: int = 24, organic_accounts: int = 16) -> DataFrame:
    """Post times of the most active accounts of each group, one row per post."""
    counts = both.groupBy("group", "author_id").agg(F.count("*").alias("n"))
    top = top_n_per_group(counts, ["group"], [F.desc("n"), F.col("author_id")], max(flagged_accounts, organic_accounts))
    limit = F.when(F.col("group") == "flagged", flagged_accounts).otherwise(organic_accounts)
    kept = top.where(F.col("rank") <= limit).select("group", "author_id", "rank")
    return both.join(kept, ["group", "author_id"]).select("group", "rank", "author_id", "created_at")
