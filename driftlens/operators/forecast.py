"""Topic volume forecasts: pooled gradient boosting, and a Hawkes process."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.operators.timelines import with_topic
from driftlens.operators.trends import dense_series, lag_features
from driftlens.session import cut_lineage

HORIZON = 6


def _feature_names() -> list[str]:
    return [*[f"lag{k}" for k in fixed.FORECAST_LAGS], "sin_hour", "cos_hour", "topic_mean"]


def gbr_forecast(series: DataFrame, horizon: int = HORIZON, min_points: int = 12, trees: int = 150,
                 depth: int = 3, rate: float = 0.05, value: str = "count_all") -> DataFrame:
    """(topic_id, model, bucket_start, predicted, lower, upper).

    One model is trained over the lag rows of all topics (with the topic mean
    as an extra feature) instead of one per topic: training is a distributed
    job, and short topics borrow strength. Topics with fewer than
    ``min_points`` hours repeat their last value. The band is the 10th and 90th
    percentile of the topic's own residuals.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    dense = cut_lineage(dense_series(series, value), "dense")
    size = dense.groupBy("topic_id").agg(
        F.count("*").alias("points"), F.avg("y").alias("topic_mean"), F.max("bucket_start").alias("last_hour"),
        F.max_by("y", "bucket_start").alias("last_y"),
    )
    long = size.where(F.col("points") >= min_points)
    rows = lag_features(dense).where("position > 1").join(long.select("topic_id", "topic_mean"), "topic_id")
    assembler = VectorAssembler(inputCols=_feature_names(), outputCol="features")
    steps = F.sequence(F.lit(1), F.lit(horizon))
    flat = size.where(F.col("points") < min_points).select("topic_id", "last_hour", "last_y", F.explode(steps).alias("h")).select(
        "topic_id", F.lit("gbr").alias("model"), _ahead("last_hour", "h"),
        F.col("last_y").alias("predicted"), F.col("last_y").alias("lower"), F.col("last_y").alias("upper"),
    )
    train = cut_lineage(rows.select("topic_id", "y", *_feature_names()), "train")
    if train.limit(1).count() == 0:
        return flat
    model = GBTRegressor(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=7).fit(
        assembler.transform(train).select("features", "y")
    )
    residuals = model.transform(assembler.transform(train)).select("topic_id", (F.col("y") - F.col("prediction")).alias("r"))
    bands = residuals.groupBy("topic_id").agg(F.percentile("r", F.lit(0.1)).alias("lo"), F.percentile("r", F.lit(0.9)).alias("hi"))
    keep = max(fixed.FORECAST_LAGS)
    recent = F.slice(F.reverse(F.sort_array(F.collect_list(F.struct("bucket_start", "y")))), 1, keep)
    tail = dense.join(long.select("topic_id", "last_hour", "topic_mean"), "topic_id").where(
        F.col("bucket_start") > F.col("last_hour") - F.expr(f"INTERVAL {keep} HOURS")
    )
    state = tail.groupBy("topic_id", "last_hour", "topic_mean").agg(F.transform(recent, lambda x: x["y"]).alias("hist"))
    out = None
    for h in range(1, horizon + 1):
        angle = F.hour(_ahead_expr("last_hour", h)) * (2 * math.pi / 24)
        step = state.select(
            "topic_id", "last_hour", "topic_mean", "hist",
            *[F.coalesce(F.get("hist", F.lit(k - 1)), F.lit(0.0)).alias(f"lag{k}") for k in fixed.FORECAST_LAGS],
            F.sin(angle).alias("sin_hour"), F.cos(angle).alias("cos_hour"),
        )
        scored = model.transform(assembler.transform(step)).withColumn("p", F.greatest(F.lit(0.0), F.col("prediction")))
        scored = cut_lineage(scored.select("topic_id", "last_hour", "topic_mean", "hist", "p"), "step")
        one = scored.select("topic_id", _ahead_expr("last_hour", h).alias("bucket_start"), "p")
        out = one if out is None else out.unionByName(one)
        state = scored.select("topic_id", "last_hour", "topic_mean",
                              F.slice(F.concat(F.array("p"), F.col("hist")), 1, keep).alias("hist"))
    banded = out.join(bands, "topic_id").select(
        "topic_id", F.lit("gbr").alias("model"), "bucket_start", F.col("p").alias("predicted"),
        F.greatest(F.lit(0.0), F.col("p") + F.col("lo")).alias("lower"), (F.col("p") + F.col("hi")).alias("upper"),
    )
    return banded.unionByName(flat)


def _ahead_expr(hour: str, h: int):
    return F.timestamp_seconds(F.unix_seconds(hour) + F.lit(h * 3600))


def _ahead(hour: str, step: str):
    return F.timestamp_seconds(F.unix_seconds(hour) + F.col(step) * 3600).alias("bucket_start")


# -- Hawkes ------------------------------------------------------------------
def event_ticks(posts: DataFrame, assign: DataFrame, series: DataFrame, tick_seconds: float = 1.0) -> DataFrame:
    """(topic_id, hours, m, span): events per topic and tick, in hours since the
    topic's first hour bucket; ``span`` is the number of hours observed.

    Counting per tick keeps a topic's rows bounded by the length of the data,
    whatever its share of the posts. It is exact for sources that report whole
    seconds, and else moves an event by less than one tick.
    """
    bounds = series.groupBy("topic_id").agg(F.min("bucket_start").alias("t0"), F.max("bucket_start").alias("t1"))
    width = int(tick_seconds * 1_000_000)
    d = with_topic(posts, assign).select("topic_id", F.unix_micros("created_at").alias("u")).join(bounds, "topic_id")
    tick = F.floor((F.col("u") - F.unix_micros("t0")) / width)
    span = ((F.unix_seconds("t1") - F.unix_seconds("t0")) / 3600 + 1).cast("double")
    return d.groupBy("topic_id", tick.alias("tick"), span.alias("span")).agg(F.count("*").alias("m")).select(
        "topic_id", (F.col("tick") * (tick_seconds / 3600.0)).alias("hours"), "m", "span"
    )


def hawkes_loglik(mu: float, alpha: float, beta: float, t: np.ndarray, m: np.ndarray, span: float) -> float:
    """Log likelihood of an exponential-kernel Hawkes process. ``m`` events at
    one tick excite each other in turn."""
    decay = np.exp(-beta * np.diff(t))
    a = np.zeros(len(t))
    for i in range(1, len(t)):
        a[i] = decay[i - 1] * (a[i - 1] + m[i - 1])
    if m.max() == 1:
        ll = np.log(mu + alpha * a).sum()
    else:
        owner = np.repeat(np.arange(len(t)), m)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        ll = np.log(mu + alpha * (a[owner] + rank)).sum()
    return float(ll - mu * span - (alpha / beta) * np.sum(m * (1.0 - np.exp(-beta * (span - t)))))


def fit_hawkes(t: np.ndarray, m: np.ndarray, span: float, rounds: int = 160) -> tuple[float, float, float]:
    """(mu, alpha, beta) by maximum likelihood from three starts, branching
    ratio below one. Nelder-Mead on (log mu, logit branching, log beta)."""
    n = float(m.sum())
    base = max(n / max(span, 1e-6) * 0.5, 1e-3)

    def unpack(x):
        ratio = 1.0 / (1.0 + math.exp(-x[1]))
        beta = math.exp(min(max(x[2], math.log(1e-3)), math.log(200.0)))
        return math.exp(x[0]), 0.999 * ratio * beta, beta

    def cost(x):
        return -hawkes_loglik(*unpack(x), t, m, span)

    best, best_cost = None, np.inf
    for beta0 in (0.5, 2.0, 10.0):
        x, f = _nelder_mead(cost, np.array([math.log(base), 0.0, math.log(beta0)]), rounds)
        if f < best_cost:
            best, best_cost = x, f
    return unpack(best)


def _nelder_mead(cost, x0: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
    simplex = [x0] + [x0 + 0.7 * np.eye(len(x0))[i] for i in range(len(x0))]
    values = [cost(x) for x in simplex]
    for _ in range(rounds):
        order = np.argsort(values)
        simplex, values = [simplex[i] for i in order], [values[i] for i in order]
        if abs(values[-1] - values[0]) < 1e-6 * (abs(values[0]) + 1e-9):
            break
        center = np.mean(simplex[:-1], axis=0)
        reflected = center + (center - simplex[-1])
        fr = cost(reflected)
        if fr < values[0]:
            expanded = center + 2.0 * (center - simplex[-1])
            fe = cost(expanded)
            simplex[-1], values[-1] = (expanded, fe) if fe < fr else (reflected, fr)
        elif fr < values[-2]:
            simplex[-1], values[-1] = reflected, fr
        else:
            inner = center + 0.5 * (simplex[-1] - center)
            fi = cost(inner)
            if fi < values[-1]:
                simplex[-1], values[-1] = inner, fi
            else:
                simplex = [simplex[0]] + [simplex[0] + 0.5 * (x - simplex[0]) for x in simplex[1:]]
                values = [values[0]] + [cost(x) for x in simplex[1:]]
    i = int(np.argmin(values))
    return simplex[i], float(values[i])


def hawkes_parameters(ticks: DataFrame, min_events: int = 10) -> DataFrame:
    """(topic_id, mu, alpha, beta, n_events, span) for topics with enough events."""
    kind = ticks.schema["topic_id"].dataType.simpleString()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("hours")
        t, m, span = pdf["hours"].to_numpy(float), pdf["m"].to_numpy(int), float(pdf["span"].iloc[0])
        if m.sum() < min_events:
            return pd.DataFrame({c: [] for c in ("topic_id", "mu", "alpha", "beta", "n_events", "span")})
        mu, alpha, beta = fit_hawkes(t, m, span)
        return pd.DataFrame({"topic_id": [pdf["topic_id"].iloc[0]], "mu": [mu], "alpha": [alpha], "beta": [beta],
                             "n_events": [int(m.sum())], "span": [span]})

    return ticks.groupBy("topic_id").applyInPandas(
        fit, f"topic_id {kind}, mu double, alpha double, beta double, n_events bigint, span double"
    )


def hawkes_expected(params: DataFrame, ticks: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """(topic_id, h, predicted): stationary background mu / (1 - ratio) plus the
    decaying excitation of the observed events, per hour ahead. Native: the
    excitation is one weighted sum per topic, scaled for every hour."""
    beta, span = F.col("beta"), F.col("span")
    seen = ticks.drop("span").join(params, "topic_id").groupBy("topic_id", "mu", "alpha", "beta", "span").agg(
        F.sum(F.col("m") * F.exp(-beta * (span - F.col("hours")))).alias("_s")
    )
    ratio = F.least(F.col("alpha") / F.col("beta"), F.lit(0.99))
    d = seen.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    kick = F.col("alpha") / F.col("beta") * F.col("_s") * (F.exp(-beta * (F.col("h") - 1)) - F.exp(-beta * F.col("h")))
    return d.select("topic_id", "h", (F.col("mu") / (1.0 - ratio) + kick).alias("predicted"))


def hawkes_forecast(posts: DataFrame, assign: DataFrame, series: DataFrame, horizon: int = HORIZON) -> DataFrame:
    ticks = cut_lineage(event_ticks(posts, assign, series), "ticks")
    last = series.groupBy("topic_id").agg(F.max("bucket_start").alias("last_hour"))
    params = cut_lineage(hawkes_parameters(ticks), "hawkes")
    d = hawkes_expected(params, ticks, horizon).join(last, "topic_id")
    none = F.lit(None).cast("double")
    return d.select("topic_id", F.lit("hawkes").alias("model"), _ahead("last_hour", "h"), "predicted",
                    none.alias("lower"), none.alias("upper"))


def compute_forecasts(series: DataFrame, posts: DataFrame, assign: DataFrame, horizon: int = HORIZON,
                      trees: int = 150) -> DataFrame:
    return gbr_forecast(series, horizon, trees=trees).unionByName(hawkes_forecast(posts, assign, series, horizon))


def backtest(series: DataFrame, posts: DataFrame | None = None, assign: DataFrame | None = None, horizon: int = HORIZON,
             min_hours: int = 48, trees: int = 150, models: tuple[str, ...] = ("naive", "gbr", "hawkes")) -> DataFrame:
    """(model, mae, n_points): the last ``horizon`` hours of every topic with
    enough history are held out and predicted."""
    dense = cut_lineage(dense_series(series), "dense")
    size = dense.groupBy("topic_id").agg(F.count("*").alias("points"), F.max("bucket_start").alias("end"))
    size = size.where(F.col("points") >= min_hours + horizon)
    cutoff = F.timestamp_seconds(F.unix_seconds("end") - F.lit(horizon * 3600))
    d = dense.join(size.select("topic_id", cutoff.alias("cutoff")), "topic_id")
    train = cut_lineage(d.where("bucket_start <= cutoff").drop("cutoff"), "train")
    test = d.where("bucket_start > cutoff").select("topic_id", "bucket_start", "y")
    predictions = train.groupBy("topic_id").agg(F.max_by("y", "bucket_start").alias("predicted"))
    out = test.join(predictions, "topic_id").select(F.lit("naive").alias("model"), "y", "predicted")
    if "gbr" in models:
        g = gbr_forecast(train.withColumnRenamed("y", "count_all"), horizon, trees=trees)
        out = out.unionByName(test.join(g, ["topic_id", "bucket_start"]).select("model", "y", "predicted"))
    if "hawkes" in models and posts is not None:
        kept = size.select("topic_id", cutoff.alias("cutoff"))
        past = with_topic(posts, assign).join(kept, "topic_id").where(
            F.unix_seconds("created_at") < F.unix_seconds("cutoff") + 3600
        ).select("platform", "post_id", "created_at")
        h = hawkes_forecast(past, assign.join(kept.select("topic_id"), "topic_id", "left_semi"),
                            train.withColumnRenamed("y", "count_all"), horizon)
        out = out.unionByName(test.join(h, ["topic_id", "bucket_start"]).select("model", "y", "predicted"))
    return out.groupBy("model").agg(
        F.round(F.avg(F.abs(F.col("y") - F.col("predicted"))), 3).alias("mae"), F.count("*").alias("n_points")
    )
