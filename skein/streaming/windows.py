"""Streaming forms of the queue and drift operators over an events stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.emptiness import is_empty


def windowed_counts(events: DataFrame, at: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and sum of values per key and tumbling window; rows later than ``late`` behind the newest are left out."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, width), key)
    return windowed.agg(F.count("*").alias("events"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), key, "events", "total")


def windowed_empty_shares(events: DataFrame, at: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Empty share of a column per key and window: drift while it happens."""
    grouped = events.withWatermark(at, late).groupBy(F.window(at, width), key)
    return grouped.agg(F.count("*").alias("rows"), F.avg(is_empty(F.col(value)).cast("double")).alias("empty_share")).select(F.col("window.start").alias("window_start"), key, "rows", "empty_share")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: events no further apart than ``gap``."""
    grouped = events.withWatermark(at, late).groupBy(F.session_window(at, gap), key)
    return grouped.agg(F.count("*").alias("events")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), key, "events")


def first_seen(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
