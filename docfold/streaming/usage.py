"""Usage counts over a stream of chat events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Counts by day; a day is given out once events cannot be that late any more."""
    days = events.withWatermark("asked_at", late).groupBy(F.window("asked_at", "1 day").alias("w"))
    return days.agg(F.count("*").alias("questions")).select(F.col("w.start").alias("day"), "questions")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user: events with less than ``gap`` between them."""
    windows = events.withWatermark("asked_at", late).groupBy("session_id", F.session_window("asked_at", gap).alias("w"))
    return windows.agg(F.count("*").alias("questions")).select("session_id", F.col("w.start").alias("first"), F.col("w.end").alias("last"), "questions")


def first_events(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; repeats within the watermark are dropped."""
    return events.withWatermark("asked_at", late).dropDuplicatesWithinWatermark([key])


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write it as Parquet and stop."""
    df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
