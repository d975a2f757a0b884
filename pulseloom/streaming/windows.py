"""Streaming twins of the daily and rolling counts: watermarked, append-only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, key: str, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(key, date, n) of a stream of events; a day closes once the watermark passes it."""
    days = F.window(F.col(ts), "1 day")
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, days.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").cast("date").alias("date"), "n")


def rolling_counts(events: DataFrame, key: str, width_days: int = 90, step_days: int = 30, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """(key, window_start, window_end, n) over sliding windows."""
    slide = F.window(F.col(ts), f"{width_days} days", f"{step_days} days")
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(key, slide.alias("w")).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")
