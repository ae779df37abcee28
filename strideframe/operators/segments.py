"""Segment algebra: rows (video, start, end), ends inclusive (W-02..W-06, P-09, P-10, J-03, J-05, J-06, A-12, X-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def steady(dx: Column, dy: Column, confidence: Column, max_shift: float | Column = 2.0, min_confidence: float = 0.2) -> Column:
    """P-10: both strict."""
    return (F.sqrt(dx * dx + dy * dy) < max_shift) & (confidence > min_confidence)


def pair_bins(pairs: DataFrame, videos: DataFrame, frames: int, key: str = "video") -> DataFrame:
    """W-02: pair i covers frames [i * n, (i + 2) * n - 1]; a video's last pair ends with its last frame.

    A video without pairs has no bins (K-07). Columns of pairs stay.
    """
    last = F.max("pair_idx").over(W.partitionBy(key))
    numbered = pairs.withColumn("__last", last).join(videos.select(key, "frames_number"), key)
    start = F.col("pair_idx") * frames
    end = F.when(F.col("pair_idx") == F.col("__last"), F.col("frames_number") - 1).otherwise((F.col("pair_idx") + 2) * frames - 1)
    return numbered.withColumns({"start": start.cast("long"), "end": end.cast("long")}).drop("__last", "frames_number")


def _islands(segments: DataFrame, key: str, joins: Column) -> DataFrame:
    """Runs of consecutive segments where each one joins its predecessor (__end: the predecessor's end).

    A run starts with its first start and ends with its last end, whatever lies between.
    """
    order = W.partitionBy(key).orderBy("start", "end")
    marked = segments.withColumn("__end", F.lag("end").over(order))
    run = F.sum(F.when(joins, 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, 0))
    place = F.row_number().over(order)
    grouped = marked.withColumns({"__run": run, "__at": place}).groupBy(key, "__run")
    return grouped.agg(F.min_by("start", "__at").alias("start"), F.max_by("end", "__at").alias("end")).drop("__run")


def unite_overlapping(segments: DataFrame, key: str = "video") -> DataFrame:
    """W-03: joined where the predecessor ends strictly after the start (K-06)."""
    return _islands(segments, key, F.col("__end") > F.col("start"))


def combine_adjacent(segments: DataFrame, key: str = "video") -> DataFrame:
    """W-04: joined where the predecessor ends one frame before the start."""
    return _islands(segments, key, F.col("__end") + 1 == F.col("start"))


def long_enough(segments: DataFrame, seconds: float, fps: Column) -> DataFrame:
    """P-09: (end - start) / fps >= seconds."""
    return segments.where(F.try_divide(F.col("end") - F.col("start"), fps) >= seconds)


def complement(segments: DataFrame, videos: DataFrame, key: str = "video") -> DataFrame:
    """W-05: what lies between segments in [0, frames - 1], sharing end points; empty first and last pieces are dropped.

    Every video of `videos` (key, frames_number) is answered; without segments it is one whole piece.
    """
    edges = videos.select(key, F.array(
        F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"), F.lit(0).alias("kind")),
        F.struct((F.col("frames_number") - 1).cast("long").alias("start"), (F.col("frames_number") - 1).cast("long").alias("end"), F.lit(2).alias("kind")),
    ).alias("e")).select(key, F.inline("e"))
    inner = segments.join(videos.select(key), key, "left_semi").select(key, F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.lit(1).alias("kind"))
    order = W.partitionBy(key).orderBy("kind", "start", "end")
    gaps = inner.unionByName(edges).select(key, "kind", F.col("end").alias("from"), F.lead("start").over(order).alias("to"), F.lead("kind").over(order).alias("next"))
    outer = (F.col("kind") == 0) | (F.col("next") == 2)
    return gaps.where(F.col("to").isNotNull() & ~(outer & (F.col("from") == F.col("to")))).select(key, F.col("from").alias("start"), F.col("to").alias("end"))


def whole_range(segments: DataFrame, videos: DataFrame, key: str = "video") -> DataFrame:
    """W-06: each video with segments, and whether its one segment is all of it."""
    sums = segments.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("start").alias("lo"), F.max("end").alias("hi")).join(videos.select(key, "frames_number"), key)
    return sums.select(key, ((F.col("n") == 1) & (F.col("lo") == 0) & (F.col("hi") == F.col("frames_number") - 1)).alias("is_whole"))


def numbered(segments: DataFrame, key: str = "video") -> DataFrame:
    """seg_idx from 0 in order of start."""
    return segments.withColumn("seg_idx", (F.row_number().over(W.partitionBy(key).orderBy("start", "end")) - 1).cast("long"))


def steady_segments(pairs: DataFrame, videos: DataFrame, frames: int = 20, max_shift: float | Column = 2.0, min_confidence: float = 0.2, min_seconds: float = 5.0, key: str = "video") -> DataFrame:
    """X-05: bins of steady pairs, united, filtered by duration, then combined; in that order (K-05).

    pairs: key, pair_idx, dx, dy, confidence. videos: key, frames_number, fps.
    max_shift may be a Column of pairs.
    """
    bins = pair_bins(pairs, videos, frames, key).where(steady(F.col("dx"), F.col("dy"), F.col("confidence"), max_shift, min_confidence))
    united = unite_overlapping(bins.select(key, "start", "end"), key).join(videos.select(key, "fps"), key)
    kept = long_enough(united, min_seconds, F.col("fps")).select(key, "start", "end")
    return numbered(combine_adjacent(kept, key), key)


def non_steady_segments(segments: DataFrame, videos: DataFrame, min_seconds: float = 2.0, key: str = "video") -> DataFrame:
    """X-06: the complement, filtered by its own duration."""
    gaps = complement(segments, videos, key).join(videos.select(key, "fps"), key)
    return numbered(long_enough(gaps, min_seconds, F.col("fps")).select(key, "start", "end"), key)


def clip_to(segments: DataFrame, extents: DataFrame, min_length: int = 120, key: str = "video") -> DataFrame:
    """J-03, P-15: each segment cut to the extents (key, first, last, ...) of its video, if longer than min_length."""
    both = extents.join(segments, key)
    cut = both.withColumns({"clip_start": F.greatest("start", "first"), "clip_end": F.least("end", "last")})
    return cut.where((F.col("clip_end") > F.col("clip_start")) & (F.col("clip_end") - F.col("clip_start") > min_length)).drop("start", "end")


def steady_runs(pairs: DataFrame, videos: DataFrame, max_shifts: Sequence[float], key: str = "video", **options) -> DataFrame:
    """X-05 at several thresholds in one pass: key, run (place of the threshold), start, end, seg_idx.

    The threshold is part of the key, so the pairs are read and sorted once.
    """
    runs = F.array(*[F.struct(F.lit(k).alias("run"), F.lit(float(x)).alias("max_shift")) for k, x in enumerate(max_shifts)])
    tried = pairs.select("*", F.inline(runs)).withColumn("__key", F.struct(key, "run")).drop(key, "run")
    several = videos.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(max_shifts) - 1))).alias("run")).withColumn("__key", F.struct(key, "run"))
    found = steady_segments(tried, several.drop(key, "run"), max_shift=F.col("max_shift"), key="__key", **options)
    return found.select(F.col("__key")[key].alias(key), F.col("__key")["run"].alias("run"), "start", "end", "seg_idx")


def compare_runs(runs: DataFrame, key: str = "video") -> DataFrame:
    """J-05, J-06, A-12: of each video in runs 0 and 1, mean and population deviation of end-point distances.

    runs: key, run, seg_idx, start, end. NaN where the runs differ in the number of segments.
    """
    at = lambda run, column: F.max(F.when(F.col("run") == run, F.col(column)))
    paired = runs.groupBy(key, "seg_idx").agg(*[at(run, c).alias(f"{c}{run}") for run in (0, 1) for c in ("start", "end")])
    ends = F.posexplode(F.array(F.abs(F.col("start0") - F.col("start1")), F.abs(F.col("end0") - F.col("end1"))))
    long = paired.select(key, F.col("start0").isNotNull().alias("in0"), F.col("start1").isNotNull().alias("in1"), ends.alias("side", "d"))
    n = lambda run: F.count_if((F.col("side") == 0) & F.col(f"in{run}"))
    sums = long.groupBy(key).agg(n(0).alias("n_a"), n(1).alias("n_b"), F.avg("d").alias("m"), F.stddev_pop("d").alias("s")).where("n_a > 0 AND n_b > 0")
    same, nan = F.col("n_a") == F.col("n_b"), F.lit(float("nan"))
    return sums.select(key, "n_a", "n_b", F.when(same, F.col("m")).otherwise(nan).alias("mean_distance"), F.when(same, F.col("s")).otherwise(nan).alias("std_distance"))


def compare(a: DataFrame, b: DataFrame, key: str = "video") -> DataFrame:
    """J-05, J-06, A-12 of two tables of segments, as `compare_runs`."""
    both = [rows.select(key, F.lit(run).alias("run"), "seg_idx", "start", "end") for run, rows in enumerate((a, b))]
    return compare_runs(both[0].unionByName(both[1]), key)


def comparison_kind() -> Column:
    """P-20: `differs`, or `unlike` where a video cannot be compared; null where the runs agree."""
    mean = F.col("mean_distance")
    return F.when(F.isnan(mean), "unlike").when(mean != 0, "differs")


def split_comparison(compared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P-20: videos that differ, and videos that cannot be compared."""
    return compared.where(comparison_kind() == "differs"), compared.where(comparison_kind() == "unlike")


def catalogue(names: Column, ids: Column, segments: Column) -> Column:
    """J-13, D11: parallel lists as one list of structs."""
    return F.arrays_zip(names.alias("filename"), ids.alias("video_id"), segments.alias("segments"))
