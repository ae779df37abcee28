"""Per-entity sequence operators (S-14, A-11, W-01, W-07..W-16, W-19, P-25..P-27, A-17)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def frame_index(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """K-11: one 0-based `frame` for each row of a video."""
    return rows.withColumn("frame", (F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def batch_means(frames: DataFrame, value: str, size: int, key: str = "video", digits: int = 6) -> DataFrame:
    """S-14, A-11: mean of each batch of frames, cut to whole numbers; the last batch may be short."""
    batch = F.floor(F.col("frame") / size).cast("long")
    mean = F.floor(F.round(F.avg(value), digits)).cast("long")
    return frames.groupBy(key, batch.alias("batch")).agg(mean.alias("mean_value"), F.count(F.lit(1)).alias("n_frames"))


def pair_deltas(batches: DataFrame, value: str = "mean_value", key: str = "video", order: str = "batch") -> DataFrame:
    """W-01: each batch against the one before: pair_idx from 0 and delta."""
    w = W.partitionBy(key).orderBy(order)
    rows = batches.select(key, (F.row_number().over(w) - 2).cast("long").alias("pair_idx"), (F.col(value) - F.lag(value).over(w)).alias("delta"))
    return rows.where("pair_idx >= 0")


def lag_difference(rows: DataFrame, value: str, shift: int, weight: Column | None = None, key: str = "curve", order: str = "frame") -> DataFrame:
    """W-07: mean weighted absolute difference at a lag, over all frames and curves; 0 at lag 0."""
    if not isinstance(shift, int) or isinstance(shift, bool):
        raise ValueError("shift must be an integer")
    gap = F.abs(F.col(value) - F.lead(value, shift).over(W.partitionBy(key).orderBy(order))) * (F.lit(1.0) if weight is None else weight)
    return rows.select(gap.alias("gap")).agg(F.avg("gap").alias("difference")) if shift else rows.agg(F.lit(0.0).alias("difference"))


def gaussian_weights(sigma: float = 3.0, radius: int = 9) -> list[float]:
    raw = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return (raw / raw.sum()).tolist()


def _extended(rows: DataFrame, value: str, radius: int, key: str, reflect: bool) -> DataFrame:
    """Rows at positions -radius .. n - 1 + radius: reflected values, or zeros, beyond the ends; __own marks the inner ones."""
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    at = F.row_number().over(W.partitionBy(key).orderBy("frame")) - 1
    base = rows.select(key, "frame", F.col(value).cast("double").alias("__v"), at.cast("long").alias("__i"), n.alias("__n"))
    if reflect:
        turns = F.transform(F.sequence(-F.ceil(F.lit(radius) / F.col("__n")).cast("long") - 1, F.ceil(F.lit(radius) / F.col("__n")).cast("long") + 1), lambda m: F.array(2 * F.col("__n") * m + F.col("__i"), 2 * F.col("__n") * m - 1 - F.col("__i")))
        places = F.filter(F.flatten(turns), lambda p: (p >= -radius) & (p < F.col("__n") + radius))
        spread = base.withColumn("__p", F.explode(places))
        return spread.select(key, "frame", "__v", "__p", (F.col("__p") == F.col("__i")).alias("__own"))
    inner = base.select(key, "frame", "__v", F.col("__i").alias("__p"), F.lit(True).alias("__own"))
    outer = base.groupBy(key).agg(F.max("__n").alias("n")).select(key, F.explode(F.concat(F.sequence(F.lit(-radius).cast("long"), F.lit(-1).cast("long")), F.sequence(F.col("n"), F.col("n") + radius - 1))).alias("__p"))
    return inner.unionByName(outer.select(key, F.lit(None).cast("long").alias("frame"), F.lit(0.0).alias("__v"), "__p", F.lit(False).alias("__own")))


def gaussian_smooth(rows: DataFrame, value: str, sigma: float = 3.0, radius: int = 9, key: str = "curve") -> DataFrame:
    """W-09: columns key, frame, smooth; edges are reflected, curves shorter than the radius several times."""
    w = W.partitionBy(key).orderBy("__p")
    out = F.lit(0.0)
    for k, weight in zip(range(-radius, radius + 1), gaussian_weights(sigma, radius), strict=True):
        out = out + F.lag("__v", -k).over(w) * F.lit(weight)
    wide = _extended(rows, value, radius, key, reflect=True)
    return wide.withColumn("smooth", out).where("__own").select(key, "frame", "smooth")


def median_filter(rows: DataFrame, value: str, kernel: int = 31, key: str = "curve") -> DataFrame:
    """W-10: columns key, frame, smooth; zeros beyond the ends."""
    half = kernel // 2
    w = W.partitionBy(key).orderBy("__p").rowsBetween(-half, half)
    wide = _extended(rows, value, half, key, reflect=False)
    return wide.withColumn("smooth", F.percentile("__v", F.lit(0.5)).over(w)).where("__own").select(key, "frame", "smooth")


def polynomial_weights(window: int, order: int = 2) -> np.ndarray:
    """Row k holds the weights of a window's values in its least-squares polynomial at place k."""
    powers = np.vander(np.arange(window) - window // 2, order + 1, increasing=True)
    return powers @ np.linalg.pinv(powers)


def polynomial_smooth(rows: DataFrame, value: str, window: int = 51, order: int = 2, key: str = "curve") -> DataFrame:
    """W-08: least-squares polynomial in a sliding window (odd); both ends take the polynomial of the outermost window.

    Columns key, frame, smooth. Frames inside a curve are sums of lagged
    values; only the `window - 1` frames of a curve's ends look at lists of
    values. A curve shorter than the window is an error.
    """
    half = window // 2
    weights = polynomial_weights(window, order)
    line = W.partitionBy(key).orderBy("frame")
    v = F.col("__v")
    at, n = F.row_number().over(line) - 1, F.count(F.lit(1)).over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    based = rows.select(key, F.col("frame").cast("long").alias("frame"), F.col(value).cast("double").alias("__v")).withColumns({"__i": at, "__n": n})
    inner = sum((F.lag(v, half - k).over(line) * F.lit(float(weights[half][k])) for k in range(window)), F.lit(0.0))
    low = F.least(F.greatest(F.col("__i") - half, F.lit(0)), F.col("__n") - window)
    end = (F.col("__i") < half) | (F.col("__i") >= F.col("__n") - half)
    # the values of the outermost windows, in order, held at the frames of the ends alone
    first = F.collect_list(F.when(F.col("__i") < window, v)).over(line.rowsBetween(-half, window - 1))
    last = F.collect_list(F.when(F.col("__i") >= F.col("__n") - window, v)).over(line.rowsBetween(-(window - 1), half))
    table = F.array(*[F.array(*map(F.lit, map(float, row))) for row in weights])
    shown = based.withColumns({"__inner": inner, "__first": F.when(F.col("__i") < half, first), "__last": F.when(F.col("__i") >= F.col("__n") - half, last)})
    some = F.when(F.col("__i") < half, F.col("__first")).otherwise(F.col("__last"))
    outer = F.aggregate(F.zip_with(some, F.get(table, (F.col("__i") - low).cast("int")), lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    short = F.raise_error(F.concat(F.lit("a curve has "), F.col("__n").cast("string"), F.lit(f" frames, fewer than the window of {window}"))).cast("double")
    smooth = F.when(F.col("__n") < window, short).when(end, outer).otherwise(F.col("__inner"))
    return shown.select(key, "frame", smooth.alias("smooth"))


def first_difference(rows: DataFrame, *values: str, key: str = "clip", order: str = "frame") -> DataFrame:
    """W-11: value minus the value before; each clip's first frame is left out."""
    w = W.partitionBy(key).orderBy(order)
    out = rows.withColumns({f"d_{v}": F.col(v) - F.lag(v).over(w) for v in values} | {"__n": F.row_number().over(w)})
    return out.where("__n > 1").drop("__n")


def contact(rows: DataFrame, x: str, y: str, z: str, limit: float = 0.002, key: str = "clip", order: str = "frame") -> DataFrame:
    """W-12: 1.0 where the squared step to the next frame is below the limit; the last frame is left out."""
    w = W.partitionBy(key).orderBy(order)
    step = sum(((F.lead(c).over(w) - F.col(c)) ** 2 for c in (x, y, z)), F.lit(0.0))
    out = rows.withColumn("__s", step).where(F.col("__s").isNotNull())
    return out.withColumn("contact", F.when(F.col("__s") < limit, 1.0).otherwise(0.0)).drop("__s")


def running_sum(rows: DataFrame, value: str, key: str = "clip", order: str = "frame", shifted: bool = True) -> DataFrame:
    """W-13: sum of all values before a frame (shifted), or up to it; 0 at the first frame when shifted."""
    w = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1 if shifted else 0)
    return rows.withColumn("total", F.coalesce(F.sum(value).over(w), F.lit(0.0)))


def rebased(rows: DataFrame, *values: str, key: str = "clip", order: str = "frame") -> DataFrame:
    """W-14: values minus those of the first frame."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumns({v: F.col(v) - F.first(v).over(w) for v in values})


def centred(rows: DataFrame, value: str, key: str = "curve") -> DataFrame:
    """W-15: value minus its curve's mean."""
    return rows.withColumn(value, F.col(value) - F.avg(value).over(W.partitionBy(key)))


def weighted_mean_curve(rows: DataFrame, value: str, key: str = "curve", order: str = "frame") -> DataFrame:
    """W-16: by frame, the mean over curves of value times its curve's population deviation."""
    weighed = rows.withColumn("__w", F.col(value) * F.stddev_pop(value).over(W.partitionBy(key)))
    return weighed.groupBy(order).agg(F.avg("__w").alias("mean_curve"))


def lively_curves(rows: DataFrame, value: str, share: float = 0.5, key: str = "curve") -> DataFrame:
    """P-27, A-17: curves whose population deviation is above a percentile of all: key, std (K-18)."""
    stds = rows.groupBy(key).agg(F.stddev_pop(value).alias("std"))
    limit = exact_percentile(stds, "std", share)  # one row
    return stds.join(F.broadcast(limit), F.col("std") > F.col("limit")).select(key, "std")


#: How far, as a share of rows, the approximate bounds of an exact percentile lie from it.
BRACKET = 0.001


def exact_percentile(rows: DataFrame, value: str, share: float) -> DataFrame:
    """One row, `limit`: the exact percentile (interpolated, nulls left out), null for an empty table.

    A sketch gives bounds a little below and above it. Values below the bounds
    are counted where they are; of those between, each distinct one goes with
    its count to the last step, about 2 * BRACKET of the rows instead of all.
    """
    v = F.col(value).cast("double")
    some = rows.select(v.alias("__v")).where(F.col("__v").isNotNull())
    shares = F.array(F.lit(max(0.0, share - BRACKET)), F.lit(min(1.0, share + BRACKET)))
    sketch = F.percentile_approx("__v", shares, F.lit(int(4 / BRACKET)))
    bounds = some.agg(F.when(F.count(F.lit(1)) > int(8 / BRACKET), sketch).otherwise(F.array(F.lit(float("-inf")), F.lit(float("nan")))).alias("__b"))
    marked = some.join(F.broadcast(bounds))  # one row
    inside = F.col("__v").between(F.col("__b")[0], F.col("__b")[1])
    sums = marked.groupBy(F.when(inside, F.col("__v")).alias("__v"), (F.col("__v") < F.col("__b")[0]).alias("__low")).agg(F.count(F.lit(1)).alias("n"))
    whole = sums.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("__low"), F.col("n"))), F.lit(0)).alias("below"))
    line = W.orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = sums.where("__v IS NOT NULL").withColumn("upto", F.sum("n").over(line)).join(F.broadcast(whole.select(F.col("n").alias("all"), "below")))
    place = F.lit(share) * (F.col("all") - 1) - F.col("below")  # among those between, from 0
    at = lambda p: F.min(F.when(F.col("upto") > p, F.col("__v")))
    found = ranked.agg(at(F.floor(place)).alias("a"), at(F.ceil(place)).alias("b"), F.first(place - F.floor(place)).alias("part"))
    return found.select((F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("limit"))


def colours(stds: DataFrame, value: str = "std") -> DataFrame:
    """A-17: min-max scale with a divisor of 0.01 at least, then (x * 0.9 + 0.2) / 1.2."""
    bounds = stds.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    scaled = (F.col(value) - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(0.01))
    return stds.join(F.broadcast(bounds)).withColumn("colour", (scaled * 0.9 + 0.2) / 1.2).drop("lo", "hi")


def grid(rows: DataFrame, *order: str, columns: int = 6) -> DataFrame:
    """W-19, O-01: place in a grid, in order: grid_row, grid_column. Meant for listings, as it numbers all rows."""
    at = F.row_number().over(W.orderBy(*order)) - 1
    return rows.withColumns({"grid_row": F.floor(at / columns).cast("long"), "grid_column": (at % columns).cast("long")})


def lead_trim(rows: DataFrame, seconds: Column, start: Column, end: Column, rate: int = 40) -> DataFrame:
    """P-25: frames in [lead + start, lead + end), where lead is `seconds` at `rate`."""
    lead = (seconds * rate).cast("int")
    return rows.where((F.col("frame") >= lead + start) & (F.col("frame") < lead + end))


def down_sample(rows: DataFrame, fps: Column, rate: int = 40) -> DataFrame:
    """P-26: every k-th frame, k = max(1, int(fps / rate))."""
    return rows.where(F.col("frame") % F.greatest(F.lit(1), (fps / rate).cast("int")) == 0)


def continuous(rows: DataFrame, quaternion: str, key: str = "video", order: str = "frame") -> DataFrame:
    """W-17: quaternions (arrays w, x, y, z) with their sign turned where they lie on the other side of the one before.

    A running number of turns decides the sign, so no frame waits for another.
    """
    line = W.partitionBy(key).orderBy(order)
    before = F.lag(quaternion).over(line)
    product = sum((F.get(quaternion, k) * F.get("__before", k) for k in range(1, 4)), F.get(quaternion, 0) * F.get("__before", 0))
    marked = rows.withColumn("__before", before).withColumn("__turn", F.when(product < 0, 1).otherwise(0))
    turns = F.sum("__turn").over(line.rowsBetween(W.unboundedPreceding, 0))
    turned = F.when(F.col("__turns") % 2 == 1, F.transform(quaternion, lambda x: -x)).otherwise(F.col(quaternion))
    return marked.withColumn("__turns", turns).withColumn(quaternion, turned).drop("__before", "__turn", "__turns")


def in_name_order(files: DataFrame, folder: str, name: str = "name") -> DataFrame:
    """O-05: files with their place, from 0, in the order of names within a folder."""
    return files.withColumn("place", F.row_number().over(W.partitionBy(folder).orderBy(name)) - 1)
