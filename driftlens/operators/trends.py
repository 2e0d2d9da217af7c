"""Topic trends: nature, rise score and its features, keyword volume alerts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.time import time_bucket
from driftlens.operators.filters import organic_flag
from driftlens.operators.links import compared
from driftlens.operators.timelines import with_topic


def topic_nature(posts: DataFrame, assign: DataFrame, flagged: DataFrame,
                 threshold: float = fixed.MANUFACTURED_SHARE) -> DataFrame:
    """(topic_id, coordinated_share, nature): all topics in one grouped query."""
    d = organic_flag(with_topic(posts, assign), flagged).groupBy("topic_id").agg(
        F.avg(F.col("is_coordinated").cast("double")).alias("_share")
    )
    return d.select(
        "topic_id", F.round("_share", 4).alias("coordinated_share"),
        F.when(F.col("_share") >= threshold, "manufactured").otherwise("organic").alias("nature"),
    )


def dense_series(series: DataFrame, value: str = "count_all") -> DataFrame:
    """(topic_id, bucket_start, y): every hour between a topic's first and last
    bucket, 0 where it had no posts."""
    bounds = series.groupBy("topic_id").agg(F.min("bucket_start").alias("lo"), F.max("bucket_start").alias("hi"))
    grid = bounds.select(
        "topic_id", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("bucket_start")
    )
    return grid.join(series.select("topic_id", "bucket_start", value), ["topic_id", "bucket_start"], "left").select(
        "topic_id", "bucket_start", F.coalesce(F.col(value), F.lit(0)).cast("double").alias("y")
    )


def lag_features(dense: DataFrame, lags: list[int] | None = None) -> DataFrame:
    """Lagged values (0 before the start) and the hour on the unit circle. A
    topic has at most one row per hour of the data range."""
    w = Window.partitionBy("topic_id").orderBy("bucket_start")
    angle = F.hour("bucket_start") * (2 * 3.141592653589793 / 24)
    return dense.select(
        "topic_id", "bucket_start", "y",
        *[F.lag("y", k, 0.0).over(w).alias(f"lag{k}") for k in (lags or fixed.FORECAST_LAGS)],
        F.sin(angle).alias("sin_hour"), F.cos(angle).alias("cos_hour"),
        F.row_number().over(w).alias("position"),
    )


def ewma_acceleration(series: DataFrame, alpha: float = 0.3, last: int = 24, dense: bool = False) -> DataFrame:
    """(topic_id, acceleration): second difference at the end of the smoothed
    counts of a topic's last ``last`` series rows; 0 with fewer than three.

    Only ``last`` rows per topic are collected into the array. ``dense`` fills
    missing hours first.
    """
    d = dense_series(series).withColumnRenamed("y", "count_all") if dense else series
    w = Window.partitionBy("topic_id").orderBy(F.desc("bucket_start"))
    tail = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    ordered = F.transform(
        F.sort_array(F.collect_list(F.struct("bucket_start", "count_all"))), lambda x: x["count_all"].cast("double")
    )
    arrays = tail.groupBy("topic_id").agg(ordered.alias("c"))
    zero = F.lit(0.0)
    smoothed = F.aggregate(
        "c",
        F.struct(F.lit(0).alias("n"), zero.alias("a"), zero.alias("b"), zero.alias("z")),
        lambda acc, x: F.struct(
            (acc["n"] + 1).alias("n"), acc["b"].alias("a"), acc["z"].alias("b"),
            F.when(acc["n"] == 0, x).otherwise(alpha * x + (1 - alpha) * acc["z"]).alias("z"),
        ),
        lambda acc: F.when(acc["n"] >= 3, acc["z"] - 2 * acc["b"] + acc["a"]).otherwise(0.0),
    )
    return arrays.select("topic_id", smoothed.alias("acceleration"))


def topic_novelty(topics: DataFrame, older_hours: int = 24) -> DataFrame:
    """(topic_id, novelty): 1 - the highest cosine to a topic first seen more
    than ``older_hours`` earlier (1 when there is none).

    Blocks of centroids are compared with blocks on the executors; a task hands
    on the highest cosine of each of its rows, so pairs are never emitted.
    """
    t = topics.select("topic_id", F.col("centroid").alias("vector"), F.unix_micros("first_seen").alias("f"))
    gap = older_hours * 3600 * 1_000_000

    def highest(ids, unit, own, seen):
        sims = unit @ unit.T
        allowed = (seen[:, None] - seen[None, :] > gap) & (ids[:, None] != ids[None, :])
        if own is not None:  # rows of one block meet in its own group
            allowed &= own[:, None] != own[None, :]
        top = np.where(allowed, sims, -np.inf).max(axis=1)
        some = np.isfinite(top)
        return ids[some], top[some]

    kind = topics.schema["topic_id"].dataType.simpleString()
    best = compared(t, "topic_id", [], highest, f"topic_id {kind}, sim double", extra="f").groupBy("topic_id").agg(F.max("sim").alias("sim"))
    return topics.select("topic_id").distinct().join(best, "topic_id", "left").select("topic_id", (1.0 - F.coalesce("sim", F.lit(0.0))).alias("novelty"))


def account_growth(posts: DataFrame, assign: DataFrame, recent_hours: int = 6) -> DataFrame:
    """(topic_id, account_growth): distinct authors in the last hours minus
    those in the hours before, as of the newest post. Only posts of the two
    windows are read past the filter."""
    latest = posts.agg(F.max("created_at")).first()[0]
    now = F.lit(latest).cast("timestamp")
    win = F.expr(f"INTERVAL {recent_hours} HOURS")
    recent = F.col("created_at") > now - win
    d = with_topic(posts.where(F.col("created_at") > now - win - win), assign)
    grown = d.groupBy("topic_id").agg(
        (F.countDistinct(F.when(recent, F.col("author_id"))) - F.countDistinct(F.when(~recent, F.col("author_id"))))
        .alias("account_growth")
    )
    return assign.select("topic_id").distinct().join(grown, "topic_id", "left").fillna(0, ["account_growth"])


def rise_scores(features: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of z-scores over all topics (population sd, 0 counts as 1).
    The moments are one row, computed once and applied as literals."""
    weights = fixed.RISE_WEIGHTS if weights is None else weights
    names = list(weights)
    m = features.agg(
        *[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in names],
        *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in names],
    ).first()
    rise = F.lit(0.0)
    for c in names:
        sd = m[f"s_{c}"] or 1.0
        rise = rise + weights[c] * (F.col(c) - F.lit(m[f"m_{c}"] or 0.0)) / F.lit(float(sd))
    return features.select(
        "topic_id", F.round(rise, 4).alias("rise"), "burst_level",
        F.round("acceleration", 3).alias("acceleration"), F.round("novelty", 4).alias("novelty"), "account_growth",
    )


def rise_features(topics: DataFrame, bursts: DataFrame, series: DataFrame, posts: DataFrame,
                  assign: DataFrame, recent_hours: int = 6) -> DataFrame:
    level = bursts.groupBy("topic_id").agg(F.max("level").alias("burst_level"))
    return (
        topics.select("topic_id")
        .join(level, "topic_id", "left").join(ewma_acceleration(series), "topic_id", "left")
        .join(topic_novelty(topics), "topic_id", "left").join(account_growth(posts, assign, recent_hours), "topic_id", "left")
        .fillna(0, ["burst_level", "acceleration", "novelty", "account_growth"])
    )


def keyword_hours(posts: DataFrame, min_chars: int = 5, texts: DataFrame | None = None, text_id: str = "text_id") -> DataFrame:
    """(keyword, hour, n): posts per lower-cased word and hour, a word once per
    post; words are stripped of ``#!.,?`` and at least ``min_chars`` long. With ``texts``
    (``text_id``, text), posts name their text by ``text_id`` and each text is split once."""
    words = F.transform(F.split("text", r"(?U)\s+"), lambda w: F.lower(F.btrim(w, F.lit("#!.,?"))))
    kept = F.array_distinct(F.filter(words, lambda w: F.length(w) >= min_chars))
    hour = time_bucket(F.col("created_at")).alias("hour")
    if texts is None:
        uses = posts.select(F.explode(kept).alias("keyword"), hour, F.lit(1).alias("uses"))
        return uses.groupBy("keyword", "hour").agg(F.sum("uses").alias("n"))
    # a row per text with the hours of its posts; a task adds them up by word and hour before anything moves
    never = -(1 << 63)
    at = F.coalesce(F.unix_micros(hour), F.lit(never).cast("bigint"))
    uses = posts.groupBy(text_id, at.alias("at")).agg(F.count("*").alias("n")).groupBy(text_id).agg(F.collect_list(F.struct("at", "n")).alias("uses"))
    d = uses.join(texts.select(text_id, kept.alias("words")), text_id).where(F.size("words") > 0)
    sums = d.select("words", F.col("uses.at").alias("at"), F.col("uses.n").alias("n")).mapInArrow(_word_hours, "keyword string, at array<bigint>, n array<bigint>")
    whole = sums.repartition("keyword").sortWithinPartitions("keyword").mapInArrow(_one_row_a_word, sums.schema)
    cells = whole.select("keyword", F.explode(F.arrays_zip("at", "n")).alias("c"))
    return cells.select("keyword", F.timestamp_micros(F.nullif("c.at", F.lit(never).cast("bigint"))).alias("hour"), "c.n")


CELLS = 1 << 22  # words times hours that a task adds up at once: 32 MB


def _word_hours(batches):
    """(keyword, at, n): posts of each word by hour, of rows (words, at, n) of one text each. What
    a task holds is given out when its words times hours pass CELLS."""
    words, hours, cells = {}, {}, np.zeros((0, 0), np.int64)

    def given():
        row, col = np.nonzero(cells[: len(words), : len(hours)])
        n, at = cells[row, col], np.array(list(hours), np.int64)[col]
        bounds, names = np.searchsorted(row, np.arange(len(words) + 1)), pa.array(list(words), pa.string())
        for i in range(0, len(words), 4096):
            part = bounds[i : i + 4097]
            inside, offsets = slice(part[0], part[-1]), (part - part[0]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([names.slice(i, 4096), *(pa.ListArray.from_arrays(offsets, pa.array(x[inside])) for x in (at, n))], ["keyword", "at", "n"])

    for batch in batches:
        for some, at, n in zip(*(batch.column(c) for c in ("words", "at", "n")), strict=True):
            some, at, n = some.values.to_pylist(), at.values.to_pylist(), n.values.to_numpy()
            many = max(1, CELLS // len(at))
            for start in range(0, len(some), many):
                part = some[start : start + many]
                if (len(words) + len(part)) * (len(hours) + len(at)) > CELLS and sum(w not in words for w in part) + len(words) > CELLS // max(1, len(hours.keys() | at)):
                    yield from given()
                    words, hours, cells = {}, {}, np.zeros((0, 0), np.int64)
                rows = np.array([words.setdefault(w, len(words)) for w in part])
                cols = np.array([hours.setdefault(h, len(hours)) for h in at])
                if len(words) > cells.shape[0] or len(hours) > cells.shape[1]:
                    grown = np.zeros((max(len(words) * 3 // 2, cells.shape[0]), max(len(hours) * 3 // 2, cells.shape[1])), np.int64)
                    grown[: cells.shape[0], : cells.shape[1]] = cells
                    cells = grown
                cells[rows[:, None], cols] += n
    if words:
        yield from given()


def _one_row_a_word(batches):
    """Rows (keyword, at, n), sorted by keyword, made one of each keyword and one cell of each of its hours."""
    held = None  # the last keyword may go on in the next batch

    def rows(names, sizes, at, n):
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.ListArray.from_arrays(bounds, pa.array(x)) for x in (at, n))], ["keyword", "at", "n"])

    for batch in batches:
        if not len(batch):
            continue
        names = batch.column("keyword").to_numpy(zero_copy_only=False)
        sizes = batch.column("at").value_lengths().to_numpy()
        at, n = (batch.column(c).flatten().to_numpy() for c in ("at", "n"))
        if held is not None:
            names, sizes = np.concatenate([[held[0]], names]), np.concatenate([[len(held[1])], sizes])
            at, n = np.concatenate([held[1], at]), np.concatenate([held[2], n])
        first = np.concatenate([[True], names[1:] != names[:-1]])
        run = np.repeat(np.cumsum(first) - 1, sizes)
        order = np.lexsort((at, run))
        run, at, n = run[order], at[order], n[order]
        heads = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (at[1:] != at[:-1])]))
        run, at, n, names = run[heads], at[heads], np.add.reduceat(n, heads), names[first]
        last = int(np.searchsorted(run, len(names) - 1))
        held = names[-1], at[last:], n[last:]
        if len(names) > 1:
            yield rows(names[:-1], np.bincount(run[:last], minlength=len(names) - 1), at[:last], n[:last])
    if held is not None:
        yield rows([held[0]], [len(held[1])], held[1], held[2])


def volume_z_alerts(posts: DataFrame, z: float = 3.0, min_total: int = 30, min_count: int = 10,
                    trailing: int = 24, counts: DataFrame | None = None) -> DataFrame:
    """(keyword, hour, count): hours whose volume exceeds the mean of the
    previous ``trailing`` hours by z * max(sd, 1), absent hours counting 0.

    No hour grid per keyword is built: only an hour with at least ``min_count``
    posts can alert, and its trailing window is a range frame over the
    keyword's own non-empty hours, with sums divided by ``trailing``.
    """
    hourly = keyword_hours(posts) if counts is None else counts
    first = hourly.agg(F.min("hour")).first()[0]
    totals = hourly.groupBy("keyword").agg(F.sum("n").alias("total"), F.max("n").alias("peak")).where(
        (F.col("total") >= min_total) & (F.col("peak") >= min_count)
    )
    d = hourly.join(totals.select("keyword"), "keyword", "left_semi").withColumn("_h", F.unix_seconds("hour"))
    w = Window.partitionBy("keyword").orderBy("_h").rangeBetween(-3600 * trailing, -3600)
    mean = F.coalesce(F.sum("n").over(w), F.lit(0)) / trailing
    square = F.coalesce(F.sum(F.col("n") * F.col("n")).over(w), F.lit(0)) / trailing
    d = d.withColumns({"_mean": mean, "_sd": F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))})
    start = F.lit(first).cast("timestamp") + F.expr(f"INTERVAL {trailing} HOURS")
    return d.where(
        (F.col("hour") >= start) & (F.col("n") >= min_count)
        & (F.col("n") > F.col("_mean") + z * F.greatest(F.col("_sd"), F.lit(1.0)))
    ).select("keyword", "hour", F.col("n").alias("count"))
