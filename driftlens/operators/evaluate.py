"""Evaluation: precision and recall, threshold choice, ablation, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import audience, fixed
from driftlens.functions.numeric import logistic
from driftlens.operators.coordination import cluster_parts
from driftlens.operators.filters import organic_flag
from driftlens.operators.timelines import with_emotions


def prf_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """precision, recall and f1, 0 where undefined, four decimals."""
    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.when(b > 0, b)).otherwise(0.0)

    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1")]


def precision_recall_f1(pred: DataFrame, truth: DataFrame, key: str = "id") -> DataFrame:
    """One row from two id sets: a full outer join and conditional counts."""
    p = pred.select(key).distinct().withColumn("p", F.lit(1))
    t = truth.select(key).distinct().withColumn("t", F.lit(1))
    d = p.join(t, key, "full").agg(
        F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"),
        F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"),
    )
    return d.select("tp", "fp", "fn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def threshold_sweep(scores: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """(label, threshold, f1): the threshold of highest F1 per label, ties to the
    one nearest 0.5, then the higher.

    ``scores``: label, score, truth BOOLEAN. Each row lands in the last
    threshold it reaches; counts per threshold are then suffix sums over the
    threshold grid, so rows are never multiplied by thresholds.
    """
    from pyspark.sql import Window

    grid = thresholds or [x / 100 for x in range(30, 100)]
    values = F.array(*[F.lit(float(t)) for t in grid])
    reached = F.size(F.filter(values, lambda t: t <= F.col("score")))
    counts = scores.groupBy("label", reached.alias("i")).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    totals = counts.groupBy("label").agg(F.sum("pos").alias("all_pos"))
    every = totals.select("label", "all_pos", F.explode(F.sequence(F.lit(1), F.lit(len(grid)))).alias("i"))
    d = every.join(counts, ["label", "i"], "left").fillna(0, ["pos", "neg"])
    w = Window.partitionBy("label").orderBy("i").rowsBetween(0, Window.unboundedFollowing)
    d = d.select("label", F.element_at(values, F.col("i")).alias("threshold"), F.sum("pos").over(w).alias("tp"),
                 F.sum("neg").over(w).alias("fp"), "all_pos")
    f1 = prf_columns(F.col("tp"), F.col("fp"), F.col("all_pos") - F.col("tp"))[2]
    d = d.select("label", "threshold", f1)
    best = F.max_by(F.struct("threshold", "f1"), F.struct("f1", -F.round(F.abs(F.col("threshold") - 0.5), 6), "threshold"))
    return d.groupBy("label").agg(best.alias("b")).select("label", "b.threshold", "b.f1")


def affect_distortion(posts: DataFrame, emotions: DataFrame, flagged: DataFrame, start, end, keyword: str,
                      dimension: str = "anxiety", threshold: float = 0.5) -> DataFrame:
    """Share of a window's posts on a keyword over the affect threshold: raw,
    organic, and their ratio."""
    d = posts.where((F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") <= F.lit(end).cast("timestamp")))
    d = organic_flag(with_emotions(d.where(F.lower("text").contains(keyword)), emotions, "inner"), flagged)
    over = (F.col(dimension) >= threshold).cast("double")
    organic = ~F.col("is_coordinated")
    m = d.agg(
        F.coalesce(F.avg(over), F.lit(0.0)).alias("r"), F.coalesce(F.avg(F.when(organic, over)), F.lit(0.0)).alias("o"),
        F.count("*").alias("raw_posts"), F.count_if(organic).alias("organic_posts"),
    )
    return m.select(F.round("r", 4).alias("raw_share"), F.round("o", 4).alias("organic_share"),
                    F.round(F.try_divide("r", "o"), 2).alias("ratio"), "raw_posts", "organic_posts")


def hash_roc(pairs: DataFrame, thresholds: list[int] | None = None, max_fpr: float = 0.01) -> DataFrame:
    """(threshold, recall, fpr, chosen) for pairs(distance, is_match). Distances
    are counted first (at most 65 values), thresholds are applied to counts."""
    grid = thresholds or list(range(0, 33, 2))
    counts = pairs.groupBy("distance").agg(F.count_if("is_match").alias("pos"), F.count_if(~F.col("is_match")).alias("neg"))
    sums = counts.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        *[F.sum(F.when(F.col("distance") <= t, F.col("pos")).otherwise(0)).alias(f"p{t}") for t in grid],
        *[F.sum(F.when(F.col("distance") <= t, F.col("neg")).otherwise(0)).alias(f"n{t}") for t in grid],
    )
    cells = ", ".join(f"{t}, p{t}, n{t}" for t in grid)
    d = sums.selectExpr("P", "N", f"stack({len(grid)}, {cells}) as (threshold, tp, fp)").select(
        "threshold", F.round(F.try_divide("tp", "P"), 4).alias("recall"), F.round(F.try_divide("fp", "N"), 4).alias("fpr")
    )
    from pyspark.sql import Window

    ok = F.col("fpr") <= max_fpr
    grid_window = Window.partitionBy(F.lit(1))  # one row per threshold
    best = F.max(F.when(ok, F.struct("recall", -F.col("threshold")))).over(grid_window)
    fallback = F.min("threshold").over(grid_window)
    chosen = F.coalesce(F.col("_best") == F.struct("recall", -F.col("threshold")), F.col("threshold") == F.col("_low"))
    return d.withColumns({"_best": best, "_low": fallback}).select("threshold", "recall", "fpr", chosen.alias("chosen"))


def weight_ablation(cluster_feats: DataFrame, account_feats: DataFrame, truth: DataFrame,
                    threshold: float = fixed.COORDINATED_SCORE) -> DataFrame:
    """(variant, tp, fp, fn, precision, recall, f1): scoring repeated with one
    weight set to zero. Features are inputs, computed once; the variants are rows
    of weights next to them, so all are counted in one pass."""
    cw, aw = fixed.CLUSTER_WEIGHTS, fixed.ACCOUNT_WEIGHTS
    variants = [("full model", cw, aw)]
    variants += [(f"cluster -{n}", {**cw, n: 0.0}, aw) for n in cw]
    variants += [(f"account -{n}", cw, {**aw, n: 0.0}) for n in aw]
    table = F.array(*[
        F.struct(F.lit(name).alias("variant"), *[F.lit(float(c[n])).alias(f"c_{n}") for n in cw],
                 *[F.lit(float(a[n])).alias(f"a_{n}") for n in aw])
        for name, c, a in variants
    ])

    def weighted(columns: dict[str, Column], prefix: str) -> Column:
        total = F.lit(0.0)
        for n, c in columns.items():
            total = total + F.col(f"w.{prefix}_{n}") * c
        return total

    cluster_score = logistic(weighted(cluster_parts(), "c") - fixed.CLUSTER_BIAS)
    account_score = logistic(weighted({n: F.col(n) for n in aw}, "a") - fixed.ACCOUNT_BIAS)
    big = cluster_feats.where(F.col("n_accounts") >= fixed.MIN_CLUSTER_ACCOUNTS).withColumn("w", F.explode(table))
    kept = big.where(cluster_score >= threshold).select("cluster", "w")
    flagged = account_feats.join(kept, "cluster").where(account_score >= threshold).select(F.col("w.variant").alias("variant"), "account_id").distinct()
    t = truth.select("account_id").distinct().withColumn("t", F.lit(1))
    n_truth = t.count()
    hits = flagged.join(t, "account_id", "left").groupBy("variant").agg(
        F.count_if(F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp")
    )
    names = cluster_feats.sparkSession.createDataFrame([(v[0],) for v in variants], "variant STRING")
    d = names.join(hits, "variant", "left").fillna(0, ["tp", "fp"]).withColumn("fn", F.lit(n_truth) - F.col("tp"))
    return d.select("variant", "tp", "fp", "fn", *prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def coverage_metrics(accounts: DataFrame, gazetteer: DataFrame, truth: DataFrame, released: DataFrame, suppressed: DataFrame, *,
                     as_of_year: int, k: int = fixed.K_ANON, keep: str = "a-z&") -> DataFrame:
    """One row: geography accuracy against ``truth(location_text, region)`` and
    coverage, age coverage, released and withheld buckets, buckets below k."""
    d = audience.infer_region(accounts, gazetteer, keep).join(
        truth.select("location_text", F.col("region").alias("_true")), "location_text", "left"
    )
    known = F.col("_true").isNotNull()
    age = audience.infer_age_bracket(F.col("bio"), as_of_year)
    m = d.agg(
        F.round(F.try_divide(F.count_if(known & (F.col("region") == F.col("_true"))), F.count_if(known)), 4).alias("geo_accuracy"),
        F.round(F.try_divide(F.count_if(known), F.count("*")), 4).alias("geo_coverage"),
        F.round(F.try_divide(F.count_if(age.isNotNull()), F.count("*")), 4).alias("age_coverage"),
    )
    r = released.agg(F.count("*").alias("released_buckets"), F.count_if(F.col("count") < k).alias("released_below_k"))
    s = suppressed.agg(F.coalesce(F.sum("suppressed_buckets"), F.lit(0)).alias("suppressed_buckets"))
    k1 = F.lit(1)
    return m.withColumn("_k", k1).join(r.withColumn("_k", k1), "_k").join(s.withColumn("_k", k1), "_k").drop("_k")


def alert_rates(alerts: DataFrame, posts: DataFrame, naive: DataFrame, high: float = fixed.HIGH_PRIORITY,
                decoy_topics: list[int] | None = None) -> DataFrame:
    """One row: alerts per day (all, high, naive) and high alerts on decoys."""
    span = posts.agg(((F.max(F.unix_micros("created_at")) - F.min(F.unix_micros("created_at"))) / 86_400_000_000).alias("d"))
    days = F.greatest(F.lit(1.0), F.col("d"))
    decoy = F.col("topic_id").isin(decoy_topics or [])
    a = alerts.agg(
        F.count("*").alias("n"), F.count_if(F.col("priority") >= high).alias("h"),
        F.count_if((F.col("priority") >= high) & decoy).alias("decoy_high_alerts"),
        F.max(F.when(decoy, F.col("priority"))).alias("decoy_max_priority"),
    )
    v = naive.agg(F.count("*").alias("v"))
    k1 = F.lit(1)
    d = a.withColumn("_k", k1).join(v.withColumn("_k", k1), "_k").join(span.withColumn("_k", k1), "_k")
    return d.select(
        F.col("n").alias("alerts_total"), F.round(F.col("n") / days, 2).alias("alerts_per_day"),
        F.round(F.col("h") / days, 2).alias("high_alerts_per_day"), F.round(F.col("v") / days, 2).alias("naive_alerts_per_day"),
        "decoy_high_alerts", "decoy_max_priority",
    )


def lead_time(first_flags: DataFrame, naive: DataFrame, keyword: str) -> DataFrame:
    """(ours, naive, lead_minutes): first burst flag against the end of the first
    alerting hour of a keyword."""
    ours = first_flags.agg(F.min("first_flag").alias("ours")).withColumn("_k", F.lit(1))
    theirs = naive.where(F.col("keyword") == keyword).agg(
        (F.min("hour") + F.expr("INTERVAL 1 HOUR")).alias("naive")
    ).withColumn("_k", F.lit(1))
    minutes = (F.unix_micros("naive") - F.unix_micros("ours")) / 60e6
    return ours.join(theirs, "_k").select("ours", "naive", F.round(minutes, 1).alias("lead_minutes"))
