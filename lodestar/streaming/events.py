"""Event streams: windows with watermarks, sessions and deduplication, on batch or streaming DataFrames alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 8) -> DataFrame:
    """A stream over a folder of Parquet files."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _late(events: DataFrame, delay: str | None) -> DataFrame:
    """Without a delay the events keep the watermark that they have."""
    if delay is None:
        return events
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay) if events.isStreaming else timed


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str | None = "10 minutes") -> DataFrame:
    """Count and sum per window and event type; late events within ``delay`` still count."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = _late(events, delay).groupBy(window, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str | None = "10 minutes") -> DataFrame:
    """Per user, stretches of events that are less than ``gap`` apart."""
    out = _late(events, delay).groupBy("user_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_of_each(events: DataFrame, delay: str | None = "10 minutes") -> DataFrame:
    """One event per id."""
    return _late(events, delay).dropDuplicates(["event_id"])
