"""Incremental ingestion with keys and references (S-20..S-25, J-01, J-10, J-12, P-21, P-22, U-03..U-06)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .numbering import prefix_sums


class Checked(NamedTuple):
    accepted: DataFrame
    rejected: DataFrame


def first_wins(rows: DataFrame, key: str | Sequence[str], ordinal: str) -> DataFrame:
    """U-04: of rows with one key, the one with the smallest ordinal."""
    return _one(rows, key, F.col(ordinal).asc())


def last_wins(rows: DataFrame, key: str | Sequence[str], ordinal: str) -> DataFrame:
    """U-06: of rows with one key, the one with the largest ordinal."""
    return _one(rows, key, F.col(ordinal).desc())


def _one(rows: DataFrame, key: str | Sequence[str], order: Column) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(order))).where("__n = 1").drop("__n")


def new_rows(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """J-01, J-10, S-03: rows whose key is not there yet; one anti-join instead of a query per row."""
    return rows.join(existing.select(key).distinct(), key, "left_anti")


def check_reference(rows: DataFrame, parents: DataFrame, reference: str, parent_key: str, reason: str = "no parent") -> Checked:
    """S-23: rows whose reference exists, and the others with a reason. A null reference is rejected."""
    keys = parents.select(F.col(parent_key).alias(reference)).distinct()
    return Checked(rows.join(keys, reference, "left_semi"), rows.join(keys, reference, "left_anti").withColumn("reason", F.lit(reason)))


def unfold_chapters(videos: DataFrame, first_id: int = 1) -> DataFrame:
    """S-24: a row for each chapter of `chapters`, with source and times as doubles; null lists give none.

    Chapters are numbered in the order of (video_id, position), by sums over
    ranges of ids; no task sees all videos. Ids are keys, so no two are equal.
    """
    sized = videos.withColumn("__n", F.coalesce(F.size("chapters"), F.lit(0))).where("__n > 0")
    placed = prefix_sums(sized, "id", "__n", "__first")
    out = placed.select(F.col("id").alias("video_id"), "__first", F.posexplode("chapters").alias("ordinal", "c"))
    times = [F.col(f"c.{x}").cast("double").alias(x) for x in ("start_time", "end_time")]
    return out.select((F.col("__first") + F.col("ordinal") + first_id).cast("long").alias("chapter_id"), "c.title", *times, F.lit("youtube").alias("source"), "video_id")


def with_defaults(rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """P-22, S-22: nulls of the named columns replaced."""
    return rows.withColumns({k: F.coalesce(F.col(k), F.lit(v)) for k, v in defaults.items()})


def json_field(document: Column, key: str, default: object = None) -> Column:
    """P-22: a top-level value of a JSON object as a string, or the default."""
    return F.coalesce(F.get_json_object(document, f"$.{key}"), F.lit(default))


def json_text(*columns: str) -> Column:
    """F-26: the columns as one JSON object."""
    return F.to_json(F.struct(*columns))


def of_length(values: Column, length: int) -> Column:
    """F-27: an array of that length, or null."""
    return F.when(F.size(values) == length, values)


def drop_keys(document: Column, keys: Sequence[str]) -> Column:
    """P-21: a map without some keys; missing keys are ignored."""
    return F.map_filter(document, lambda k, _: ~k.isin(*keys)) if keys else document


def cascade_delete(channels: DataFrame, videos: DataFrame, chapters: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S-25: the three tables without the channels in `gone` (id) and all that refers to them."""
    left = channels.join(gone, "id", "left_anti")
    lost = videos.join(gone.withColumnRenamed("id", "channel_id"), "channel_id", "left_semi")
    videos_left = videos.join(gone.withColumnRenamed("id", "channel_id"), "channel_id", "left_anti")
    return left, videos_left, chapters.join(lost.select(F.col("id").alias("video_id")), "video_id", "left_anti")


def difference(rows: DataFrame, drop: DataFrame, key: Sequence[str]) -> DataFrame:
    """U-03."""
    return rows.join(drop.select(*key).distinct(), list(key), "left_anti")
