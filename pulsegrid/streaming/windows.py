"""Windows, sessions and deduplication over event streams, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str) -> DataFrame:
    """Event time as a timestamp with a watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def tumbling(events: DataFrame, size: str, *by: str, delay: str = "1 hour") -> DataFrame:
    found = timed(events, delay).groupBy(F.window("ts", size), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, *by: str, delay: str = "1 hour") -> DataFrame:
    found = timed(events, delay).groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def once(events: DataFrame, *keys: str, delay: str = "1 hour") -> DataFrame:
    return timed(events, delay).dropDuplicatesWithinWatermark(list(keys))
