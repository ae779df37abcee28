"""Schemas of the tables (D1..D16, S-20). Frames are 0-based, segment ends inclusive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CHANNEL = "id string not null, name string not null, info string"
VIDEO = "id string not null, title string not null, duration bigint not null, info string, channel_id string"
CHAPTER = "chapter_id bigint not null, title string, start_time double, end_time double, source string, video_id string"
VIDEO_FILE = "video string, filename string, width int, height int, fps double, frames_number bigint"
REGISTRATION = "video string, pair_idx bigint, dx int, dy int, confidence double"
SEGMENT = "video string, seg_idx bigint, start bigint, end bigint"
TRACK = "video string, track int, frame bigint, bbox array<float>, keypoints array<array<float>>"
LANDMARK = "video string, frame bigint, joint int, x double, y double, z double, visibility double"
JOINTS = "clip string, frame bigint, joints array<double>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """S-20: a table without rows."""
    return spark.createDataFrame([], schema)
