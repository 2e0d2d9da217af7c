"""Statistics of the gaps between successive posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.numeric import burstiness, gap_bin, gap_entropy_from_counts
from driftlens.functions.sequence import with_previous
from driftlens.functions.time import epoch_seconds, slot

BINS = 12


def inter_post_gaps(posts: DataFrame, keys: list[str], ts: str = "created_at",
                    order: list[str] | None = None, slot_seconds: int = 86_400) -> DataFrame:
    """Posts plus ``gap_s``, the seconds since the previous post of the key
    (NULL for the first)."""
    order = order or [ts, "post_id"]
    out = with_previous(posts, keys, order, slot(F.col(ts), slot_seconds), {"_prev_ts": ts})
    return out.withColumn("gap_s", epoch_seconds(F.col(ts)) - epoch_seconds(F.col("_prev_ts"))).drop("_prev_ts")


def gap_aggregates(gap: str = "gap_s", window: float = fixed.SYNC_SECONDS) -> list[Column]:
    """Aggregates that every statistic below is computed from."""
    g = F.col(gap)
    return [
        F.count("*").alias("n_posts"),
        F.count(g).alias("n_gaps"),
        F.avg(g).alias("gap_mean"),
        F.stddev_pop(g).alias("gap_sd"),
        F.count_if(g <= window).alias("near_gaps"),
        F.array(*[F.count_if(gap_bin(g) == i).cast("double") for i in range(BINS)]).alias("gap_bins"),
    ]


def gap_statistics(gaps: DataFrame, keys: list[str], window: float = fixed.SYNC_SECONDS) -> DataFrame:
    """burstiness, normalised gap entropy and synchrony per key, one shuffle.

    Entropy counts sit in twelve aggregate columns rather than in a second
    group-by. Synchrony divides by the number of posts, not of gaps.
    """
    d = gaps.groupBy(*keys).agg(*gap_aggregates(window=window))
    return d.select(
        *keys, "n_posts", "n_gaps",
        burstiness(F.col("n_gaps"), F.col("gap_mean"), F.col("gap_sd")).alias("burstiness"),
        gap_entropy_from_counts(F.col("gap_bins"), BINS).alias("gap_entropy"),
        F.coalesce(F.try_divide(F.col("near_gaps"), F.col("n_posts")), F.lit(0.0)).alias("synchrony"),
    )


def exact_median(df: DataFrame, keys: list[str], value: str, width: float = 1.0) -> DataFrame:
    """Exact median per key in two passes without holding a group in memory:
    counts per bin of ``width`` locate the middle ranks, then only the rows of
    those bins are ranked."""
    from pyspark.sql import Window

    rows = df.where(F.col(value).isNotNull()).withColumn("_bin", F.floor(F.col(value) / width))
    bins = rows.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    total = rows.groupBy(*keys).agg(F.count("*").alias("_total"))
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    marked = bins.withColumn("_cum", F.sum("_n").over(upto)).join(total, keys)
    lo, hi = F.floor((F.col("_total") + 1) / 2), F.floor((F.col("_total") + 2) / 2)
    before = F.col("_cum") - F.col("_n")
    middle = marked.where((F.col("_cum") >= lo) & (before < hi)).select(
        *keys, "_bin", before.alias("_before"), lo.alias("_lo"), hi.alias("_hi")
    )
    ranked = rows.join(middle, [*keys, "_bin"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value))
    )
    hit = ranked.where((F.col("_rank") == F.col("_lo")) | (F.col("_rank") == F.col("_hi")))
    return hit.groupBy(*keys).agg(F.avg(value).alias("median"))
