"""Event counts by time window, over batches and streams alike (beyond the reference)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by window and type; on a stream, late rows are dropped after `late`."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), "event_type", "n")


def latest_by_key(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only log: job states, progress."""
    rest = [c for c in log.columns if c not in (key, order)]
    return log.groupBy(key).agg(F.max(order).alias(order), *[F.max_by(c, order).alias(c) for c in rest])
