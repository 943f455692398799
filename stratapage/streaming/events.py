"""Windows over event streams, for batch and streaming frames alike (beyond the document operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stream of Parquet files that appear under path."""
    return spark.readStream.schema(schema).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows; events later than ``late`` are left out of a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
