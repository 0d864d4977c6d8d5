"""Streaming extension: windowed counts of late-arriving events. The report engine itself has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums for each window and key; rows later than `late` behind the newest are left out by a stream."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return (
        stamped.withWatermark(time, late)
        .groupBy(F.window(time, width), *by)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *by, "n", "total")
    )


def sessions(events: DataFrame, time: str, gap: str, user: str) -> DataFrame:
    """Sessions of each user that end after a gap without events."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    found = stamped.groupBy(F.session_window(time, gap), user).agg(F.count(F.lit(1)).alias("n"))
    return found.select(user, F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), F.col("session_window.end").cast("timestamp_ntz").alias("session_end"), "n")
