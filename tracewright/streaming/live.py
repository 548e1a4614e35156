"""Boundaries of frames that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window, user_id, n, peak of a stream of events with ``ts``: tumbling windows, late rows beyond ``late`` dropped."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak")).select(F.col("window.start").alias("start"), "user_id", "n", "peak")


def sessions(events: DataFrame, gap: str = "3 hours", late: str = "6 hours") -> DataFrame:
    """start, end, user_id, n: runs of a user's events with no gap as long as ``gap``."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
