"""Time expressions. Storage is UTC; one feature buckets by display-zone hour."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions import fixed


def epoch_seconds(ts: Column) -> Column:
    """Seconds since the epoch, sub-second part kept."""
    return F.unix_micros(ts) / F.lit(1e6)


def time_bucket(ts: Column, width: str = "1h") -> Column:
    units = {"1m": "minute", "1h": "hour", "1d": "day"}
    if width in units:
        return F.date_trunc(units[width], ts)
    if width == "10m":
        return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / 600) * 600)
    raise ValueError(f"unknown bucket width {width!r}")


def slot(ts: Column, seconds: int) -> Column:
    """Number of the fixed-width slot that holds ``ts``."""
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("bigint")


def display_hour(ts: Column, zone: str = fixed.DISPLAY_ZONE) -> Column:
    return F.hour(F.from_utc_timestamp(ts, zone))


def parse_iso(value: Column) -> Column:
    """ISO-8601 text to TIMESTAMP; NULL when it is not one."""
    return F.try_to_timestamp(value)


def parse_event_time(value: Column, now: Column | None = None) -> Column:
    """Export-file time: IST suffix, unix seconds, four formats, then ISO.

    ``now`` is used for a missing value (the current time by default).
    """
    now = F.current_timestamp() if now is None else now
    v = F.trim(value)
    bare = F.regexp_replace(v, r"(?i)\s+IST$", "")
    local = F.try_to_timestamp(bare, F.lit("yyyy-MM-dd HH:mm:ss"))
    formats = ["yyyy-MM-dd HH:mm:ss z", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd"]
    parsed = F.coalesce(*[F.try_to_timestamp(v, F.lit(f)) for f in formats], F.try_to_timestamp(v))
    return (
        F.when(value.isNull() | (value == ""), now)
        .when(v.rlike(r"(?i)\sIST$"), F.to_utc_timestamp(local, fixed.DISPLAY_ZONE))
        .when(v.rlike(r"^\d+$"), F.timestamp_seconds(F.expr("1L") * v.try_cast("bigint")))
        .otherwise(parsed)
    )
