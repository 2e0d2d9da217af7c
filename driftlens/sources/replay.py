"""Replay files: JSON lines, one canonical record per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _to_raw(lines: DataFrame) -> DataFrame:
    payload = F.trim("value")
    kept = lines.where((payload != "") & ~F.col("value").startswith("#"))
    return kept.select(
        F.coalesce(F.get_json_object(payload, "$.platform"), F.lit("synthetic")).alias("platform"),
        F.lit("replay").alias("collector_id"),
        F.current_timestamp().alias("collected_at"),
        payload.alias("payload"),
        F.coalesce(F.get_json_object(payload, "$.created_at"), F.lit("")).alias("created_at"),
    )


def read_replay_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of a replay file in event-time order (a range-partitioned
    sort; blank and comment lines are skipped)."""
    return _to_raw(spark.read.text(path)).orderBy("created_at")


def stream_replay_jsonl(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The same records as a stream over a landing directory."""
    return _to_raw(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))
