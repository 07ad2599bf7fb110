"""Streaming twins of the search-log statistics. Each works on a batch and on a stream alike.

``late`` sets the watermark of a stream; where operators are chained, the first sets it and the rest take None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.pivot import mean


def _watermarked(events: DataFrame, late: str | None) -> DataFrame:
    return events.withWatermark("ts", late) if events.isStreaming and late else events


def windowed_counts(events: DataFrame, width: str = "1 day", late: str | None = "2 days") -> DataFrame:
    """Counts and means by window and type; rows later than the watermark are let go."""
    out = _watermarked(events, late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), mean("value").alias("mean"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def once(events: DataFrame, late: str | None = "8 days") -> DataFrame:
    """Each event once, however often overlapping loads bring it."""
    return _watermarked(events, late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = "2 days") -> DataFrame:
    """Sessions of users: runs of events without a gap."""
    out = _watermarked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")
