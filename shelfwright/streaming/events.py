"""The event log as a stream: deduplication within a watermark and windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A stream over the parquet files of a folder, with the schema of a static table."""
    return spark.readStream.schema(like.schema).parquet(folder)


def unique_events(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each event_id once as long as its repetitions come within the delay; later ones are dropped with the state."""
    return events.filter("event_id is not null").withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def action_counts(events: DataFrame, length: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """(start, target, action, n) of tumbling windows over received_at; for batches and, in append mode, streams."""
    rows = events.withColumn("received_at", F.col("received_at").cast("timestamp")).withWatermark("received_at", delay).groupBy(F.window("received_at", length), "target", "action").agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "target", "action", "n")
