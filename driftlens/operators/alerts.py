"""Alerts from bursts, their review, cases, evidence and digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions import text as tx
from driftlens.functions.numeric import priority
from driftlens.functions.rules import stance
from driftlens.functions.sequence import top_n_per_group
from driftlens.operators.filters import POST_KEY, organic_flag
from driftlens.operators.timelines import with_emotions, with_topic
from driftlens.session import cut_lineage


def best_burst_per_topic(bursts: DataFrame, min_level: int = 1) -> DataFrame:
    """The strongest burst of each topic by (level, weight)."""
    d = bursts.where(F.col("level") >= min_level)
    return d.groupBy("topic_id").agg(
        F.max_by(F.struct("start", "end", "level", "weight"), F.struct("level", "weight", "start")).alias("b")
    ).select("topic_id", "b.*")


SLOT_SECONDS = 21_600


def _slot(moment: str | Column) -> Column:
    return F.floor(F.unix_seconds(moment) / SLOT_SECONDS)


def inside_bursts(bursts: DataFrame, posts: DataFrame) -> DataFrame:
    """Posts (with a topic_id) that lie inside a burst of their topic, with the
    burst. A burst is listed under each time slot that it touches and a post
    under its own, so a post meets only the bursts around it; the exact range is
    a residual condition."""
    slots = bursts.withColumn("_slot", F.explode(F.sequence(_slot("start"), _slot("end"))))
    d = posts.withColumn("_slot", _slot("created_at")).join(slots, ["topic_id", "_slot"])
    return d.where((F.col("created_at") >= F.col("start")) & (F.col("created_at") <= F.col("end"))).drop("_slot")


def burst_window_stats(bursts: DataFrame, posts: DataFrame, assign: DataFrame, emotions: DataFrame,
                       flagged: DataFrame) -> DataFrame:
    """Per burst: posts, coordinated share, accounts, anxiety shift against the
    topic's posts outside the window (0 without any), platforms."""
    d = organic_flag(with_emotions(with_topic(posts, assign), emotions), flagged)
    keys = ["topic_id", "start", "end", "level", "weight"]
    inside = inside_bursts(bursts, d).groupBy(*keys).agg(
        F.count("*").alias("n_posts"),
        F.count_if("is_coordinated").alias("_coord"),
        F.countDistinct("author_id").alias("n_accounts"),
        F.sum("anxiety").alias("_sum"), F.count("anxiety").alias("_n"),
        F.sort_array(F.collect_set("platform")).alias("platforms"),
    )
    # outside a burst is all of the topic less what is inside
    whole = d.groupBy("topic_id").agg(F.sum("anxiety").alias("_all_sum"), F.count("anxiety").alias("_all_n"))
    stats = bursts.select(*keys).join(whole, "topic_id").join(inside, keys, "left").fillna(0, ["n_posts", "_coord", "n_accounts", "_n"]).fillna(0.0, ["_sum"])
    anxious = F.coalesce(F.try_divide("_sum", "_n"), F.lit(0.0))
    out = F.try_divide(F.coalesce("_all_sum", F.lit(0.0)) - F.col("_sum"), F.col("_all_n") - F.col("_n"))
    return stats.select(
        *keys, "n_posts", "n_accounts",
        F.coalesce(F.try_divide("_coord", "n_posts"), F.lit(0.0)).alias("coordinated_share"),
        (anxious - F.coalesce(out, anxious)).alias("anxiety_shift"), F.coalesce("platforms", F.array().cast("array<string>")).alias("platforms"),
    )


def reach_percentile(stats: DataFrame, size: str = "n_posts") -> DataFrame:
    """Rows plus ``reach``: share of rows whose size is at most this one.

    The running count is over distinct sizes, not over rows, so no row-level
    window without a partition is needed.
    """
    sizes = stats.groupBy(size).agg(F.count("*").alias("_n"))
    w = Window.orderBy(size)  # distinct sizes only
    total = F.sum("_n").over(Window.partitionBy(F.lit(1)))
    cum = sizes.select(size, (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).alias("reach"))
    return stats.join(cum, size)


def headline(kind: Column, label: Column, posts: Column, accounts: Column, share: Column) -> Column:
    percent = F.rint(share * 100).cast("bigint").cast("string")
    return F.concat(
        kind, F.lit(": "), label, F.lit(" - "), posts.cast("string"), F.lit(" posts from "),
        accounts.cast("string"), F.lit(" accounts, "), percent, F.lit("% from coordinated accounts"),
    )


def generate_alerts(bursts: DataFrame, topics: DataFrame, posts: DataFrame, assign: DataFrame, emotions: DataFrame,
                    flagged: DataFrame, previous: DataFrame | None = None, min_posts: int = 10) -> DataFrame:
    """One alert per topic from its strongest burst. Earlier alerts with a
    status other than ``new`` are kept as they are."""
    stats = burst_window_stats(best_burst_per_topic(bursts), posts, assign, emotions, flagged)
    d = reach_percentile(stats).where(F.col("n_posts") >= min_posts).join(topics.select("topic_id", "label"), "topic_id")
    kind = F.when(F.col("coordinated_share") >= fixed.MANUFACTURED_SHARE, "Manufactured surge").otherwise("Organic burst")
    fresh = d.select(
        F.substring(F.sha2(F.concat_ws("|", F.col("topic_id").cast("string"), F.unix_micros("start").cast("string")), 256), 1, 16).alias("alert_id"),
        "topic_id",
        priority(F.col("level"), F.col("coordinated_share"), F.col("anxiety_shift"), F.col("reach")).alias("priority"),
        headline(kind, F.col("label"), F.col("n_posts"), F.col("n_accounts"), F.col("coordinated_share")).alias("headline"),
        F.struct(
            "topic_id", F.col("level").alias("burst_level"), F.col("weight").alias("burst_weight"), "coordinated_share",
            "anxiety_shift", F.col("reach").alias("reach_percentile"), "platforms", "n_posts", "start", "end",
        ).alias("evidence"),
        F.lit("new").alias("status"),
    )
    if previous is None:
        return fresh
    reviewed = previous.where(F.col("status") != "new")
    return reviewed.unionByName(fresh.join(reviewed.select("alert_id"), "alert_id", "left_anti"))


def alerts_by_priority(alerts: DataFrame, topics: DataFrame | None = None, status: str | None = None,
                       limit: int = 50) -> DataFrame:
    d = alerts if status is None else alerts.where(F.col("status") == status)
    if topics is not None:
        d = d.join(topics.select("topic_id", F.col("label").alias("topic_label"), "nature"), "topic_id", "left")
    return d.orderBy(F.desc("priority"), "alert_id").limit(limit)


def review_alerts(alerts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with the latest decision applied, cases).

    ``decisions``: alert_id, action (approve, watchlist, dismiss, ack, case),
    title?, decided_at. Approving or casing an alert opens a case.
    """
    table = F.create_map(*[F.lit(x) for pair in fixed.DECISION_STATUS.items() for x in pair])
    named = decisions.withColumn("_status", F.try_element_at(table, F.col("action"))).where("_status IS NOT NULL")
    latest = named.groupBy("alert_id").agg(F.max_by("_status", F.struct("decided_at", "action")).alias("_status"))
    updated = alerts.join(latest, "alert_id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")
    opened = named.where(F.col("action").isin("approve", "case"))
    cases = opened.join(alerts.select("alert_id", "priority", "headline"), "alert_id").select(
        F.sha2(F.concat_ws("|", "alert_id", F.unix_micros("decided_at").cast("string")), 256).alias("case_id"),
        "alert_id", F.substring(F.coalesce("title", "headline"), 1, 200).alias("title"),
        F.col("decided_at").alias("created_at"), "priority", "headline",
    )
    return updated, cases


def evidence_posts(alerts: DataFrame, posts: DataFrame, assign: DataFrame, raw_records: DataFrame, n: int = 50) -> DataFrame:
    """First ``n`` posts of each alert's topic inside its window with the hash
    of the raw record they came from."""
    windows = alerts.select("alert_id", "topic_id", F.col("evidence.start").alias("_lo"), F.col("evidence.end").alias("_hi"))
    d = with_topic(posts, assign).join(windows, "topic_id").where(
        (F.col("created_at") >= F.coalesce("_lo", F.lit("0001-01-01").cast("timestamp")))
        & (F.col("created_at") <= F.coalesce("_hi", F.lit("9999-12-31").cast("timestamp")))
    )
    first = top_n_per_group(
        d.select("alert_id", *POST_KEY, "text", "created_at", "ledger_seq"),
        ["alert_id"], [F.col("created_at"), F.col("platform"), F.col("post_id")], n,
    )
    return first.join(raw_records.select(F.col("seq").alias("ledger_seq"), "record_hash"), "ledger_seq", "left")


def covering_checkpoints(evidence: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """(alert_id, checkpoint rows) overlapping each alert's span of records.

    Checkpoints tile the sequence in blocks, so the overlap is an equi join on
    block numbers rather than a range join: a span is exploded into the blocks
    it touches, a checkpoint into the blocks it covers.
    """
    block = fixed.CHECKPOINT_SIZE
    span = evidence.where("ledger_seq IS NOT NULL").groupBy("alert_id").agg(
        F.min("ledger_seq").alias("lo"), F.max("ledger_seq").alias("hi")
    )
    mine = span.withColumn("block", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.col("hi") / block))))
    theirs = checkpoints.withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("first_seq") / block), F.floor(F.col("last_seq") / block)))
    )
    hit = mine.join(theirs, "block").where((F.col("last_seq") >= F.col("lo")) & (F.col("first_seq") <= F.col("hi")))
    return hit.select("alert_id", *checkpoints.columns).distinct()


def evidence_index(alerts: DataFrame, posts: DataFrame, assign: DataFrame, raw_records: DataFrame,
                   checkpoints: DataFrame, emotions: DataFrame, flagged: DataFrame,
                   coord_clusters: DataFrame | None = None) -> dict[str, DataFrame]:
    """Everything a case brief rests on, per alert."""
    evidence = evidence_posts(alerts, posts, assign, raw_records)
    topics = alerts.select("alert_id", "topic_id")
    d = organic_flag(with_emotions(with_topic(posts, assign), emotions, "inner"), flagged).join(topics, "topic_id")
    organic = ~F.col("is_coordinated")
    affect = d.groupBy("alert_id").agg(
        *[F.avg(a).alias(f"raw_{a}") for a in fixed.AFFECT_DIMENSIONS],
        *[F.avg(F.when(organic, F.col(a))).alias(f"organic_{a}") for a in fixed.AFFECT_DIMENSIONS],
        F.count("*").alias("raw_n"), F.count_if(organic).alias("organic_n"),
    )
    out = {"posts": evidence, "checkpoints": covering_checkpoints(evidence, checkpoints), "affect": affect}
    if coord_clusters is not None:
        best = coord_clusters.groupBy("topic_id").agg(F.max_by("cluster", F.struct("score", "cluster")).alias("cluster"))
        out["cluster"] = topics.join(best, "topic_id").join(coord_clusters.drop("topic_id"), "cluster")
    return out


def digest_input(posts: DataFrame, assign: DataFrame, max_posts: int = fixed.DIGEST_POSTS,
                 texts: DataFrame | None = None, text_id: str = "text_id") -> DataFrame:
    """(topic_id, n, text, stance, ...): first use of each distinct text per
    topic, oldest first, sanitised. The texts meet by hash, and only the posts
    that survive the cut carry their text. With ``texts`` (``text_id``, text), posts carry
    ``text_hash`` and ``text_id`` instead of a text, and only the kept ones look theirs up."""
    if texts is None:
        posts, texts, where = posts.withColumn("text_hash", F.md5("text")), posts.select(*POST_KEY, "text"), POST_KEY
    else:
        texts, where = texts.select(text_id, "text"), [text_id]
    d = with_topic(posts, assign)
    first = d.groupBy("topic_id", "text_hash").agg(
        F.min_by(F.struct(*dict.fromkeys([*POST_KEY, *where, "created_at", "kind"])), F.struct("created_at", *POST_KEY)).alias("p")
    ).select("topic_id", "p.*")
    kept = top_n_per_group(first, ["topic_id"], [F.col("created_at"), *[F.col(c) for c in POST_KEY]], max_posts, "n")
    if where != POST_KEY:
        kept = cut_lineage(kept, "digest")  # few rows: measured, they go to the texts
    return kept.join(texts, where).select(
        "topic_id", "n", "platform", "created_at",
        tx.sanitize_post(F.col("text")).alias("text"), stance(F.col("text"), F.col("kind")).alias("stance"),
    )


def grounding_check(summaries: DataFrame, posts: DataFrame, assign: DataFrame,
                    max_words: int = fixed.SUMMARY_WORDS) -> DataFrame:
    """(topic_id, accepted, reason): rejects a candidate summary that contains
    an injection marker, a link, @handle or #tag absent from its topic's posts,
    or too many words, in that order.

    A token is grounded when some post of the topic contains it as text; tokens
    are few, so they meet the topic's posts by an equi join on the topic.
    """
    blob = F.lower("summary")
    token = F.regexp_extract_all(blob, F.lit(r"(?U)https?://\S+|[@#]\w+"), F.lit(0))
    d = summaries.select(
        "topic_id", "summary", F.transform(token, lambda t: F.rtrim(t, F.lit('.,")'))).alias("tokens"),
        tx.contains_any(blob, fixed.INJECTION_MARKERS).alias("injected"),
        F.size(F.filter(F.split("summary", r"(?U)\s+"), lambda w: w != "")).alias("words"),
    )
    asked = d.select("topic_id", F.explode(F.array_distinct("tokens")).alias("token"))
    wanted = asked.select("topic_id").distinct()
    texts = with_topic(posts, assign).join(wanted, "topic_id").select("topic_id", F.lower("text").alias("t"))
    found = texts.join(asked, "topic_id").where(F.expr("contains(t, token)")).select("topic_id", "token").distinct()
    missing = asked.join(found, ["topic_id", "token"], "left_anti").groupBy("topic_id").agg(F.min("token").alias("missing"))
    reason = (
        F.when(F.col("injected"), "injection marker")
        .when(F.col("missing").isNotNull(), F.concat(F.lit("ungrounded token: "), "missing"))
        .when(F.col("words") > max_words, "too long")
    )
    return d.join(missing, "topic_id", "left").select("topic_id", reason.isNull().alias("accepted"), reason.alias("reason"))

