"""Export files in CSV form to canonical raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import fixed
from driftlens.functions.time import parse_event_time


def _with_row_number(df: DataFrame) -> DataFrame:
    """Zero-based position in file order, without a global sort: position in
    the partition plus the rows in earlier partitions."""
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    part = F.shiftright("_mid", 33)
    local = F.col("_mid").bitwiseAND((1 << 33) - 1)
    tagged = tagged.withColumn("_part", part).withColumn("_local", local).drop("_mid")
    sizes = tagged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per input split
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return tagged.join(offsets, "_part").withColumn("row_number", F.col("_offset") + F.col("_local")).drop(
        "_part", "_local", "_offset"
    )


def _pick(columns: dict[str, list[str]], names: list[str]) -> Column:
    """First non-empty column in alias order; NULL when none."""
    found = [F.trim(F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`"))) for n in names for c in columns.get(n, [])]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def import_export_csv(spark: SparkSession, path: str, platform: str, source: str,
                      now: Column | None = None) -> DataFrame:
    """Raw records (payload as a struct) from an export file.

    Headers match case-insensitively with spaces as underscores; the first
    non-empty alias wins. A record without an id gets the first 16 hex digits
    of sha256("source:row:text").
    """
    if platform not in fixed.EXPORT_PLATFORMS:
        raise ValueError(f"platform must be one of {fixed.EXPORT_PLATFORMS}")
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    columns: dict[str, list[str]] = {}
    for c in rows.columns:
        columns.setdefault(c.lstrip("﻿").lower().strip().replace(" ", "_"), []).append(c)
    rows = _with_row_number(rows)
    pick = {field: _pick(columns, names) for field, names in fixed.EXPORT_COLUMNS.items()}
    text = F.coalesce(pick["text"], F.lit(""))
    made_up = F.substring(
        F.sha2(F.concat_ws(":", F.lit(source), F.col("row_number").cast("string"), text), 256), 1, 16
    )
    kinds = F.create_map(*[F.lit(x) for pair in fixed.EXPORT_KINDS.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, F.lower(F.coalesce(pick["kind"], F.lit("post")))), F.lit("post"))
    metric_columns = [(m, c) for m in fixed.EXPORT_METRICS for c in columns.get(m, [])]
    metrics = F.map_filter(
        F.create_map(*[x for m, c in metric_columns for x in (F.lit(m), F.col(f"`{c}`").try_cast("double"))])
        if metric_columns else F.create_map().cast("map<string,double>"),
        lambda _, v: v.isNotNull(),
    )
    synthetic = F.lower(F.coalesce(_pick(columns, ["synthetic"]), F.lit(""))).isin("1", "true", "yes")
    payload = F.struct(
        F.lit(platform).alias("platform"),
        F.coalesce(pick["post_id"], made_up).alias("post_id"),
        F.coalesce(pick["author_id"], F.lit("unknown")).alias("author_id"),
        kind.alias("kind"),
        text.alias("text"),
        parse_event_time(pick["created_at"], now).alias("created_at"),
        pick["parent_post_id"].alias("parent_post_id"),
        metrics.alias("metrics"),
        synthetic.alias("synthetic"),
        F.lit(source).alias("import_source"),
    )
    return rows.select(
        F.lit(platform).alias("platform"),
        F.lit(f"import_csv:{platform}").alias("collector_id"),
        F.current_timestamp().alias("collected_at"),
        payload.alias("payload"),
    )
