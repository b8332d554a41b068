"""Streams of frames and results: Structured Streaming over folders of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.video import register


def frame_stream(spark: SparkSession, path: str, planes: str = "yuv", frames_per_task: int = 256) -> DataFrame:
    """Frames of the Y4M files below a folder as they are written, each once: offsets are frames of files, so that a file may grow between triggers and a restart goes on inside it."""
    register(spark)
    return spark.readStream.format("y4m").option("path", path).option("planes", planes).option("framesPerTask", frames_per_task).load()


def running_averages(results: DataFrame, time: str, by: list[str], value: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and count of a value by group and window; rows later than the watermark are left out, and state is dropped behind it."""
    return results.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.round(F.avg(value), 6).alias("mean"), F.count(value).alias("n")).select(F.col("window.start").alias("start"), *by, "mean", "n")
