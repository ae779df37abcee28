"""Person tracks in long form: (video, track, frame, ...) (A-05..A-10, P-11..P-14, J-04, J-09, J-14, A-08, X-18)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window as W

TRACK = ("video", "track")

#: Tracks of a block whose pairs are returned, and of one that is only searched; each LONG words of a track count as one more.
PAIRED, SEARCHED, LONG = 1024, 4096, 64

#: Pairs of tracks that are counted at once.
CELLS = 1 << 17


def extents(tracks: DataFrame, key: tuple[str, ...] = TRACK) -> DataFrame:
    """A-05: number of frames, first and last frame."""
    return tracks.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("frame").alias("first"), F.max("frame").alias("last"))


def stable(found: DataFrame, min_frames: Column | float, fill: float = 0.95) -> DataFrame:
    """P-11, P-12: extents with more than min_frames frames and n / (last - first) > fill (may exceed 1)."""
    return found.where((F.col("n") > min_frames) & (F.try_divide(F.col("n"), F.col("last") - F.col("first")) > fill))


def credibility(tracks: DataFrame, confidence: Column, points: int = 17, key: tuple[str, ...] = TRACK) -> DataFrame:
    """A-06: mean key-point confidence over the track's span; missing frames count as 0."""
    span = (F.max("frame") - F.min("frame") + 1) * points
    return tracks.groupBy(*key).agg((F.sum(confidence) / span).alias("credibility"))


def credible(scored: DataFrame, least: float = 0.9) -> DataFrame:
    """P-13."""
    return scored.where(F.col("credibility") > least)


def _blocks(tracks: DataFrame, key: tuple[str, ...], size: int):
    """Tracks (block, track, n, words) of a video grouped by each two of its blocks (video, low, high) that may meet.

    A track's frames are bits in words of 64. Blocks follow the order of first
    words, and a track goes to those blocks only whose words reach into its own,
    so two tracks that meet do so in one group, which has all frames of both.
    """
    video, track = key
    frame = F.col("frame").cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), frame.bitwiseAND(F.lit(63)).cast("int"))
    rows = tracks.select(F.col(video).alias("video"), F.col(track).alias("track"), F.shiftright(frame, 6).alias("word"), bit.alias("bit"))
    words = rows.where("video IS NOT NULL AND track IS NOT NULL").groupBy("video", "track", "word").agg(F.bit_or("bit").alias("bits"))
    own = words.groupBy("video", "track").agg(
        F.sum(F.coalesce(F.bit_count("bits"), F.lit(1))).alias("n"),  # null frames count as one and meet none
        F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "bits"))).alias("words"), F.min("word").alias("first"), F.max("word").alias("last"),
    ).where("first IS NOT NULL")
    weight = F.floor(F.size("words") / LONG) + 1
    before = F.sum(weight).over(W.partitionBy("video").orderBy("first", "track").rowsBetween(W.unboundedPreceding, W.currentRow)) - weight
    block = W.partitionBy("video", "block")
    placed = own.withColumn("block", F.floor(before / size)).withColumn("span", F.struct("block", F.min("first").over(block).alias("first"), F.max("last").over(block).alias("last")))
    spans = placed.withColumn("spans", F.collect_set("span").over(W.partitionBy("video")))
    near = F.filter("spans", lambda s: (s["first"] <= F.col("last")) & (s["last"] >= F.col("first")))
    dealt = spans.select("video", "block", "track", "n", "words", F.explode(F.transform(near, lambda s: s["block"])).alias("other"))
    dealt = dealt.select("video", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "track", "n", "words")
    parts = int(tracks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    return dealt.repartition(parts, "video", "low", "high").groupBy("video", "low", "high")


def _side(table: pa.Table, block: int):
    """A block's tracks, their numbers of frames, and for each word its track's place, its number and its bits."""
    mine = table.filter(pa.array(table["block"].to_numpy() == block))
    words = mine["words"].combine_chunks()
    flat = words.flatten()
    place = np.repeat(np.arange(len(mine)), words.value_lengths().to_numpy())
    return mine["track"].combine_chunks(), mine["n"].to_numpy(), place, flat.field("word").to_numpy(), flat.field("bits").to_numpy().view(np.uint64)


def _common(left, right, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Numbers of common frames of some of the left tracks, from the place given, with all right ones; a track has none with itself."""
    size, width = len(left[0]), len(right[0])
    order = np.argsort(right[3], kind="stable")
    known, starts = np.unique(right[3][order], return_index=True)
    ends = np.append(starts[1:], len(order))
    step = max(1, CELLS // max(1, width))
    for low in range(0, size, step):
        high = min(size, low + step)
        counts = np.zeros((high - low, width), np.int64)
        a, b = np.searchsorted(left[2], [low, high])
        turn = a + np.argsort(left[3][a:b], kind="stable")
        mine, cuts = np.unique(left[3][turn], return_index=True)
        for k, word in enumerate(mine):
            at = np.searchsorted(known, word)
            if at == len(known) or known[at] != word:
                continue
            x, y = turn[cuts[k] : cuts[k + 1] if k + 1 < len(cuts) else None], order[starts[at] : ends[at]]
            met = np.bitwise_count(left[4][x][:, None] & right[4][y])
            if met.shape == counts.shape:
                counts += met
            else:
                counts[np.ix_(left[2][x] - low, right[2][y])] += met
        if same:
            counts[np.arange(high - low), np.arange(low, high)] = 0
        yield low, counts


def _sides(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]):
    table, (low, high) = pa.Table.from_batches(batches), (k.as_py() for k in key[1:])
    left = _side(table, low)
    return left, left if low == high else _side(table, high)


def _paired(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right = _sides(key, batches)
    for low, counts in _common(left, right, left is right):
        x, y = np.nonzero(counts)
        common, x = counts[x, y], x + low
        for one, two, i, j in ((left, right, x, y), (right, left, y, x))[: 1 if left is right else 2]:
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(i)), one[0].take(pa.array(i)), two[0].take(pa.array(j)), pa.array(common / one[1][i])], names=["video", "track", "other", "overlap"])


def overlaps(tracks: DataFrame, key: tuple[str, ...] = TRACK) -> DataFrame:
    """J-04, A-07: for each track and each other one of its video, the share of its frames they have in common.

    Pairs are made and counted block by block and never exchanged; a frame that a track lists twice counts once.
    """
    video, track = (tracks.schema[k].dataType for k in key)
    made = StructType([StructField(n, t) for n, t in (("video", video), ("track", track), ("other", track), ("overlap", DoubleType()))])
    return _blocks(tracks, key, PAIRED).applyInArrow(_paired, made).toDF(*key, "other", "overlap")


def single_person(tracks: DataFrame, most: float = 0.05, key: tuple[str, ...] = TRACK) -> DataFrame:
    """P-14: tracks none of whose overlaps exceeds `most`; either side of a pair may go, a lone track stays."""

    def crowded(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = _sides(key, batches)
        rows, columns = np.zeros(len(left[0]), np.int64), np.zeros(len(right[0]), np.int64)
        for low, counts in _common(left, right, left is right):
            rows[low : low + len(counts)] = counts.max(axis=1, initial=0)
            np.maximum(columns, counts.max(axis=0, initial=0), out=columns)
        for side, common in ((left, rows), (right, columns))[: 1 if left is right else 2]:
            bad = side[0].filter(pa.array((common > 0) & (common / side[1] > most)))
            yield pa.RecordBatch.from_arrays([pa.repeat(key[0], len(bad)), bad], names=["video", "track"])

    made = StructType([StructField(k, tracks.schema[c].dataType) for k, c in zip(TRACK, key, strict=True)])
    bad = _blocks(tracks, key, SEARCHED).applyInArrow(crowded, made).toDF(*key).distinct()
    return tracks.select(*key).distinct().join(bad, list(key), "left_anti")


def vote(*results: DataFrame, min_votes: int = 2, key: tuple[str, ...] = TRACK) -> DataFrame:
    """A-08, U-07: tracks that at least min_votes results list (K-08)."""
    every = reduce(DataFrame.unionByName, [r.select(*key) for r in results])
    return every.groupBy(*key).agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= min_votes)


def envelope(boxes: DataFrame, box: Column, by: tuple[str, ...]) -> DataFrame:
    """A-09: least and greatest corner of boxes (x1, y1, x2, y2), cut to integers; the greatest is 0 at least."""
    high = lambda k: F.greatest(F.max(box[k]), F.lit(0.0)).cast("int")
    return boxes.groupBy(*by).agg(
        F.min(box[1]).cast("int").alias("min_h"), high(3).alias("max_h"), F.min(box[0]).cast("int").alias("min_w"), high(2).alias("max_w")
    )


def max_size(boxes: DataFrame, box: Column, by: tuple[str, ...]) -> DataFrame:
    """A-10: greatest height and width, each with a margin of 2."""
    return boxes.groupBy(*by).agg((F.max(box[3] - box[1]) + 2).alias("max_height"), (F.max(box[2] - box[0]) + 2).alias("max_width"))


def own_box(boxes: Column, track: Column) -> Column:
    """J-14, O-03: the first box whose id (index 4) is the track's, as small integers; null where none is."""
    found = F.filter(boxes, lambda b: b[4] == track)
    return F.try_element_at(found, F.lit(1)).cast("array<smallint>")


def tracks_to_crop(every: DataFrame, surviving: DataFrame, compat: bool = False, key: tuple[str, ...] = TRACK) -> DataFrame:
    """J-09, K-09: surviving tracks; with compat, all tracks of videos that have a survivor."""
    by = [key[0]] if compat else list(key)
    return every.join(surviving.select(*by).distinct(), by, "left_semi")


def only_track(tracks: DataFrame, min_frames: int = 150, fill: float = 0.95, key: tuple[str, ...] = TRACK) -> DataFrame:
    """X-18: the stable track of videos that have one track only."""
    found = extents(tracks, key)
    alone = found.groupBy(key[0]).agg(F.count(F.lit(1)).alias("k")).where("k = 1").select(key[0])
    return stable(found.join(alone, key[0], "left_semi"), min_frames, fill)


def detections(rows: DataFrame, least: float, person: int = 0) -> DataFrame:
    """P-17, P-18: rows (conf, cls) above a confidence and of the person class."""
    return rows.where((F.col("conf") > least) & (F.col("cls") == person))
