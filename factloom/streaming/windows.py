"""Event-time windows; the same plans run over tables and over streams with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    # a watermark needs instants; times without a zone are the session's
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def tumbling(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(starts, event_type, n) of every window; with a slide windows overlap.  Rows later than ``late`` are dropped from streams only."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _marked(events, late).groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, starts, ends, n) of every run of a user's events with less than the gap between them."""
    return _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("starts"), F.col("w.end").alias("ends"), "n")
