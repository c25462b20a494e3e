"""Streams of trace events: session status with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, per_trigger: int = 1) -> DataFrame:
    """Parquet files of the events schema as they arrive."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def session_status(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """``user_id, start, end, n, status`` of sessions; any error makes one failed.  Works on batches and streams."""
    s = F.session_window("ts", gap)
    status = F.when(F.max((F.col("event_type") == "error").cast("int")) == 1, "failed").otherwise("completed")
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy("user_id", s.alias("w")).agg(F.count(F.lit(1)).alias("n"), status.alias("status")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "status")


def hourly_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """``hour, event_type, n, mean`` in tumbling windows."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("hour"), "event_type", "n", "mean")
