"""Row-to-previous-row access that survives one key holding most of the rows.

A plain ``lag`` over ``partitionBy(key)`` sorts a whole key in one task. Here
the window is partitioned by (key, time slot); only the first row of each slot
needs its predecessor from another slot, and that comes from a per-slot summary
with one row per (key, slot).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: list[str], order: list[str], slot: Column,
                  carry: dict[str, str]) -> DataFrame:
    """Adds ``carry`` columns {new name: source column} taken from the previous
    row of the same key. ``slot`` must not decrease along ``order``."""
    names = list(carry)
    packed = F.struct(*[F.col(carry[n]).alias(n) for n in names])
    base = df.withColumn("_slot", slot).withColumn("_packed", packed)
    in_slot = Window.partitionBy(*keys, "_slot").orderBy(*order)
    rows = base.withColumn("_near", F.lag("_packed").over(in_slot))
    summary = base.groupBy(*keys, "_slot").agg(F.max_by("_packed", F.struct(*order)).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_slot")
    summary = summary.select(*keys, "_slot", F.lag("_last").over(across).alias("_far"))
    joined = rows.join(summary, [*keys, "_slot"], "left")
    before = F.coalesce("_near", "_far")
    return joined.withColumns({n: before[n] for n in names}).drop("_slot", "_packed", "_near", "_far")


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                    rank: str = "rank") -> DataFrame:
    """First ``n`` rows per group; the optimiser limits per map task first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def numbered(df: DataFrame, order: list[str], into: str) -> DataFrame:
    """Rows with their place along ``order``, from 0 without gaps. Ranges are sorted in
    parallel and written once; only the number of rows of each is gathered."""
    from driftlens.session import cut_lineage

    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    d = cut_lineage(d.withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part, before, starts = F.shiftright("_id", 33), 0, []
    for r in sorted(d.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()):
        starts.append((r["_part"], before))
        before += r["n"]
    table = spark.createDataFrame(starts, "_part long, _from long")  # a row per partition
    d = d.withColumn("_part", part).join(F.broadcast(table), "_part")
    return d.withColumn(into, F.col("_id").bitwiseAND((1 << 33) - 1) + F.col("_from")).drop("_part", "_id", "_from")
