"""Structured Streaming forms. Each takes a streaming (or batch) frame and returns one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_parquet(spark: SparkSession, path: str, schema: str, files_each: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(path)


def tumbling(events: DataFrame, time: str, size: str, by: str, late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by key in tumbling (or sliding) windows; later data than ``late`` is dropped by a stream."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: str, late: str = "1 hour") -> DataFrame:
    w = F.session_window(time, gap)
    out = events.withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def once_each(events: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: repairs repeats after a restart."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
