"""Event-time extensions: what the tables' batch operators do, over a stream with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, time: str, by: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window start and end, by, n, total) for tumbling or sliding windows; works on streams and on tables."""
    held = events.withColumn(time, F.col(time).cast("timestamp"))
    held = held.withWatermark(time, late) if events.isStreaming else held
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = held.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """(user, start, end, n): runs of a user's events with no gap between them as long as gap."""
    held = events.withColumn(time, F.col(time).cast("timestamp"))
    held = held.withWatermark(time, late) if events.isStreaming else held
    out = held.groupBy(F.session_window(time, gap).alias("w"), user).agg(F.count("*").alias("n"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
