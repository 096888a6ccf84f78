"""Streams of events: the last progress of each stage, rates in windows, and duplicates that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame) -> DataFrame:
    """The last event of each stage (in update or complete mode)."""
    return events.where("stage IS NOT NULL").groupBy("stage").agg(F.max(F.struct("ts", "done", "total", "unit")).alias("e")).select("stage", "e.*")


def windowed(events: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum a window and key; events later than `late` are left out, and windows are final after that."""
    w = events.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "n", "total")


def once(events: DataFrame, time: str, keys: list[str], late: str = "2 hours") -> DataFrame:
    """Each event once, also if its repetition comes later, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
