"""Findings while data arrive. The reference has no streams: this carries its counts over to unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """window_start, window_end, key, n; rows later than ``late`` don't count. For a stream or a table."""
    t = F.col(ts).cast("timestamp")
    rows = events.select(t.alias("_t"), F.col(key))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    return rows.where("_t is not null").groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.select(F.col(ts).cast("timestamp").alias("_t"), F.col(key))
    rows = rows.withWatermark("_t", late) if events.isStreaming else rows
    return rows.where("_t is not null").groupBy(F.session_window("_t", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def distinct_events(events: DataFrame, ts: str, key: str, late: str = "2 hours") -> DataFrame:
    """The first of each key, as far back as the watermark reaches."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
