"""Structured Streaming forms of bounded sequence operators (S-14, A-11, W-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_means(frames: DataFrame, time: str, value: str, key: str = "video", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """A-11 over a stream: mean and count per key and tumbling window; rows later than `late` are left out."""
    return (
        frames.withWatermark(time, late)
        .groupBy(F.window(time, width).alias("w"), key)
        .agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_frames"))
        .select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "mean_value", "n_frames")
    )


def session_segments(frames: DataFrame, time: str, key: str = "video", gap: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """W-03 over a stream: runs of rows with no gap of `gap` or more."""
    return (
        frames.withWatermark(time, late)
        .groupBy(F.session_window(time, gap).alias("s"), key)
        .agg(F.count(F.lit(1)).alias("n_frames"))
        .select(key, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n_frames")
    )
