"""Structured Streaming: windowed counts with late data, sessions, last writes, and resumable batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_parquet_stream(spark: SparkSession, path: str, per_batch: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream, a few files per batch."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, key, n, total) per tumbling window; on a stream a window closes once the watermark has passed it."""
    t = events.withColumn("at", F.col(time).cast("timestamp"))
    t = t.withWatermark("at", late) if events.isStreaming else t
    out = t.groupBy(F.window("at", size), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").alias("start"), "key", "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """(user, start, end, n) of activity without a gap."""
    t = events.withColumn("at", F.col(time).cast("timestamp"))
    t = t.withWatermark("at", late) if events.isStreaming else t
    out = t.groupBy(F.session_window("at", gap), F.col(user).alias("user")).agg(F.count("*").alias("n"))
    return out.select("user", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_available(df: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> None:
    """Process everything that is there, then stop; a later call goes on where this one ended."""
    df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
