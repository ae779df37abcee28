"""What would be written, cut or downloaded, as tables (S-28..S-33, X-06, P-06, F-20, F-25, J-07, J-08, J-11, P-16, A-03, A-04, U-01)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def large_enough(width: Column, height: Column, least: int = 360) -> Column:
    """P-06, K-21: the longer side is above the threshold."""
    return F.greatest(width, height) > least


def video_length(frames: Column, fps: Column) -> Column:
    """S-13, F-20: seconds; null at 0 fps."""
    return F.try_divide(frames, fps)


def clips(segments: DataFrame, videos: DataFrame, filter_name: str, key: str = "video") -> DataFrame:
    """S-28, S-29, F-09, F-20: a row for each clip: path, mode (copy for a whole video, else cut), seconds.

    videos: key, filename, frames_number, fps.
    """
    rows = segments.select(key, "start", "end").join(videos.select(key, "filename", "frames_number", "fps"), key)
    whole = (F.col("start") == 0) & (F.col("end") == F.col("frames_number") - 1)
    path = text.segment_name(text.stem(F.col("filename")), filter_name, F.col("start"), F.col("end"))
    return rows.select(key, "start", "end", path.alias("path"), F.when(whole, "copy").otherwise("cut").alias("mode"), F.try_divide(F.col("start"), F.col("fps")).alias("start_seconds"), F.try_divide(F.col("end"), F.col("fps")).alias("end_seconds"))


def crops(fragments: DataFrame, envelopes: DataFrame, key: Sequence[str] = ("video", "track")) -> DataFrame:
    """S-30, F-10, F-25: fragments with their track's box and its size."""
    boxed = fragments.join(envelopes, list(key))
    return boxed.withColumns({"width": F.col("max_w") - F.col("min_w"), "height": F.col("max_h") - F.col("min_h")})


def padding(width: Column, height: Column, box_width: Column, box_height: Column) -> tuple[Column, Column, Column, Column]:
    """F-25: left, right, top and bottom borders that centre a box in a frame; the left and top ones take half, cut."""
    x, y = width - box_width, height - box_height
    left, top = F.floor(x / 2).cast("int"), F.floor(y / 2).cast("int")
    return left, x - left, top, y - top


def chapter_clips(chapters: DataFrame, done: DataFrame, offset: int = 1) -> DataFrame:
    """S-31, F-02..F-04, J-10: clips to fetch, but for those that are there (name, size) with more than 1024 bytes."""
    low, high = text.clip_bounds(F.col("start_time"), F.col("end_time"), offset)
    rows = chapters.withColumns({"clip_start": low, "clip_end": high})
    named = rows.withColumns({
        "name": text.clip_name(F.col("video_id"), F.col("clip_start"), F.col("clip_end")),
        "link": text.embed_link(F.col("video_id"), F.col("clip_start"), F.col("clip_end")),
    })
    return named.join(done.where("size > 1024").select("name").distinct(), "name", "left_anti")


def videos_to_fetch(videos: DataFrame, done: DataFrame) -> DataFrame:
    """S-32: videos without a file of the same stem in any extension; with their watch link."""
    there = done.select(text.stem(F.col("name")).alias("id")).distinct()
    return videos.join(there, "id", "left_anti").withColumn("link", text.watch_link(F.col("id")))


def steady_folder(name: Column) -> Column:
    """S-33: the non-steady marker is looked for first."""
    return F.when(name.contains("nonsteady"), "nonsteady").when(name.contains("steady"), "steady")


def route(files: DataFrame, strategy: str = "do_not_sort", sources: DataFrame | None = None) -> DataFrame:
    """S-33, K-20: files (name) with `bucket`; by_source_filename needs sources (stem)."""
    if strategy == "do_not_sort":
        return files.withColumn("bucket", F.lit(None).cast("string"))
    if strategy == "steady_non_steady":
        return files.withColumn("bucket", steady_folder(F.col("name")))
    if strategy == "by_source_filename" and sources is not None:
        both = contains_join(files.select("name", F.col("name").alias("__t")), sources.select("stem", F.col("stem").alias("__p")), "name", "__t", "stem", "__p")
        found = both.groupBy("name").agg(F.min("stem").alias("bucket"))
        return files.join(found, "name", "left")
    raise ValueError(f"unknown strategy {strategy!r}")


def contains_join(texts: DataFrame, parts: DataFrame, text_key: str, text_column: str, part_key: str, part_column: str) -> DataFrame:
    """J-11, F-11: pairs (text_key, part_key) where the text contains the part; empty parts are left out.

    An equi-join on blocks instead of a nested loop: a text is cut into blocks
    of w characters, a part of 2 * w - 1 or more holds a whole block at one of
    its first w offsets. Parts fall into four classes of length, each with its
    own w; the exact test follows on the distinct candidates. Texts are not
    cut for a class that has no parts. Parts of one or two characters meet all
    texts that hold the first one, which is about what they return.
    """
    size = F.length(part_column)
    classes = ((16, None), (4, 30), (2, 6), (1, 2))
    there = parts.agg(*[F.coalesce(F.bool_or((size >= 2 * w - 1) & (size <= most if most else F.lit(True))), F.lit(False)) for w, most in classes]).first()
    found = parts.join(texts, F.lit(False)).select(text_key, part_key)
    for w, most in [x for x, used in zip(classes, there, strict=True) if used]:
        some = parts.where((size >= 2 * w - 1) & (size <= most if most else F.lit(True)))
        offsets = F.array(*[F.substring(F.col(part_column), F.lit(i), F.lit(w)) for i in range(1, w + 1)])
        grams = some.select(part_key, F.explode(F.array_distinct(offsets)).alias("__k"))
        blocks = texts.select(text_key, F.explode(F.array_distinct(F.regexp_extract_all(text_column, F.lit(f"(?s).{{{w}}}"), F.lit(0)))).alias("__k"))
        pairs = blocks.join(grams, "__k").select(text_key, part_key)
        found = found.unionByName(pairs)
    tested = found.distinct().join(texts.select(text_key, text_column), text_key).join(parts.select(part_key, part_column), part_key)
    return tested.where(F.contains(F.col(text_column), F.col(part_column))).select(text_key, part_key)


def class_counts(train: DataFrame, validation: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """P-16, U-01, A-04: rows of each class in both tables, 0 where none."""
    listed = train.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    both = validation.select(label).unionByName(train.select(label)).where(F.col(label).isin(list(classes)))
    return listed.join(both.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label, "left").select(label, F.coalesce("n", F.lit(0)).alias("n_rows"))


def link_statistics(rows: DataFrame, file: str) -> DataFrame:
    """A-03: rows, files, rows per file."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(file).alias("n_files"), F.try_divide(F.count(F.lit(1)), F.count_distinct(file)).alias("rows_per_file"))


def allowed(rows: DataFrame, allow_list: DataFrame, key: str) -> DataFrame:
    """J-08."""
    return rows.join(allow_list.select(key).distinct(), key, "left_semi")


def with_joints(videos: DataFrame, joints: DataFrame, skip_missing: bool = True) -> DataFrame:
    """J-07: by stem; skip_missing leaves out videos without joints, else they keep nulls."""
    return videos.join(joints, "stem", "inner" if skip_missing else "left")
