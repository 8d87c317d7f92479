"""The audit log as a stream: it only grows, so its Parquet folder is a Structured Streaming source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import Tables


def audit_stream(spark: SparkSession, root: str, files_per_trigger: int | None = None) -> DataFrame:
    """A streaming DataFrame of the registry's audit events."""
    tables = Tables(spark, root)
    reader = spark.readStream.schema(tables.schema("audit"))
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(tables.path("audit"))


def action_counts(events: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Events per tumbling window and action; windows close ``late`` after the newest event."""
    timed = events.withWatermark("occurred_at", late)
    return timed.groupBy(F.window("occurred_at", window).alias("window"), "action").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "action", "n")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of each actor: periods without a pause of ``gap``."""
    timed = events.withWatermark("occurred_at", late)
    return timed.groupBy(F.session_window("occurred_at", gap).alias("session"), "actor").agg(F.count("*").alias("n")).select("actor", F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), "n")
