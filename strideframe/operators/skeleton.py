"""Skeletons of 17 joints in a flat array of 51 numbers (V-01..V-14, V-24..V-26, F-28, F-29, F-31, P-23, P-24).

Numeric joint indices only: 0 root, 1-3 and 4-6 legs, 7 and 8 spine, 9 and 10
neck and head, 11-13 and 14-16 arms.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as g

JOINTS = 17


def joints_of(flat: Column, n: int = JOINTS) -> list[g.Vector]:
    return [g.joint(flat, k) for k in range(n)]


def _bones(flat: Column, *pairs: tuple[int, int]) -> Column:
    total = None
    for a, b in pairs:
        length = g.norm(g.sub(g.joint(flat, a), g.joint(flat, b)))
        total = length if total is None else total + length
    return total


def spine_length(flat: Column) -> Column:
    """V-01."""
    return _bones(flat, (0, 7), (7, 8))


def leg_length(flat: Column) -> Column:
    """V-02: mean of both legs."""
    return _bones(flat, (2, 1), (3, 2), (5, 4), (6, 5)) * 0.5


def neck_head_length(flat: Column) -> Column:
    """V-03."""
    return _bones(flat, (10, 8))


def height(flat: Column) -> Column:
    """V-04."""
    return leg_length(flat) + spine_length(flat) + neck_head_length(flat)


def _scaled(flat: Column, factor: Column, n: int = JOINTS) -> Column:
    return F.array(*[flat[k].cast("double") * factor for k in range(3 * n)])


def align_heights(frames: DataFrame, joints: str = "joints", clip: str = "clip", in_average: bool = True) -> DataFrame:
    """V-05..V-07, A-13: every clip (or every frame) scaled to the mean of the clips' mean heights.

    The mean does not weigh clips by their frames. Heights of 0 give nulls.
    """
    tall = frames.withColumn("__h", height(F.col(joints)))
    clips = tall.groupBy(clip).agg(F.avg("__h").alias("__m"))
    target = clips.agg(F.avg("__m").alias("__t"))  # one row
    if in_average:
        factors = clips.join(F.broadcast(target)).select(clip, F.try_divide(F.col("__t"), F.col("__m")).alias("__f"))
        scaled = frames.join(factors, clip)
    else:
        scaled = tall.join(F.broadcast(target)).withColumn("__f", F.try_divide(F.col("__t"), F.col("__h")))
    return scaled.withColumn(joints, _scaled(F.col(joints), F.col("__f"))).select(*frames.columns)


def height_statistics(frames: DataFrame, joints: str = "joints", clip: str = "clip") -> DataFrame:
    """A-13, A-14: mean and population deviation of the clips' mean heights."""
    clips = frames.groupBy(clip).agg(F.avg(height(F.col(joints))).alias("m"))
    return clips.agg(F.avg("m").alias("mean_height"), F.stddev_pop("m").alias("std_height"))


def root_frame(flat: Column, orthonormal: bool = False) -> tuple[g.Vector, g.Vector, g.Vector]:
    """V-08: axes x, y, z at the root: x across the hips, y up the spine, z = x cross y.

    As is (K-12): z is not scaled and y becomes x cross z. orthonormal: z is
    scaled to length 1 and y becomes z cross x.
    """
    x = g.unit(g.sub(g.joint(flat, 4), g.joint(flat, 1)))
    return _root_axes(x, g.unit(g.sub(g.joint(flat, 7), g.joint(flat, 0))), orthonormal)


def _root_axes(x: g.Vector, up: g.Vector, orthonormal: bool) -> tuple[g.Vector, g.Vector, g.Vector]:
    z = g.cross(x, up)
    if orthonormal:
        z = g.unit(z)
        return x, g.cross(z, x), z
    return x, g.cross(x, z), z


def shift_to_origin(flat: Column, n: int = JOINTS) -> Column:
    """V-11: all joints minus the root."""
    root = g.joint(flat, 0)
    return g.flat([g.sub(j, root) for j in joints_of(flat, n)])


def align_globally(flat: Column, keep_root: bool = True, orthonormal: bool = False) -> Column:
    """V-09, V-10: joints minus the root, in the root frame's axes; slot 0 holds the root itself if keep_root."""
    root = g.joint(flat, 0)

    def turn(v: list[Column]) -> Column:
        turned = [g.rotate((v[:3], v[3:6], v[6:]), g.sub(j, root)) for j in joints_of(flat)]
        return g.flat([root, *turned[1:]] if keep_root else turned)

    return _with_axes(flat, lambda x, u: _root_axes(x, u, orthonormal), (4, 1), (7, 0), turn)


def _with_axes(flat: Column, axes, first: tuple[int, int], second: tuple[int, int], body) -> Column:
    """body over the nine components of axes(a, b), for the unit vectors along two bones."""
    units = [*g.unit(g.sub(g.joint(flat, first[0]), g.joint(flat, first[1]))), *g.unit(g.sub(g.joint(flat, second[0]), g.joint(flat, second[1])))]
    return g.let(units, lambda v: g.let([c for a in axes(tuple(v[:3]), tuple(v[3:])) for c in a], body))


def features(flat: Column, direction: g.Vector) -> tuple[Column, ...]:
    """V-12: root position, and the dot product of a direction with the last row (z components of x, y, z) of the frame matrix."""
    x, y, z = root_frame(flat)
    return (*g.joint(flat, 0), g.dot((x[2], y[2], z[2]), direction))


def stacked(flat: Column, use_root_depth: bool = False) -> Column:
    """V-14, P-23, D17: 51 numbers, or 50 without the root's depth (index 2)."""
    whole = F.slice(flat, 1, 3 * JOINTS).cast("array<double>")
    return whole if use_root_depth else F.concat(F.slice(whole, 1, 2), F.slice(whole, 4, 3 * JOINTS - 3))


def with_zero_root(values: Column) -> Column:
    """F-28: the 49-wide layout (16 joints and a last value): joints with a zero root before them."""
    return F.concat(F.array(*[F.lit(0.0)] * 3), F.slice(values, 1, 48))


def subset(flat: Column, n: int = 22) -> Column:
    """P-24: the first n joints."""
    return F.slice(flat, 1, 3 * n)


def mirrored(flat: Column, pairs: Sequence[tuple[int, int]], n: int) -> Column:
    """F-29, F-31: joint pairs exchanged and x negated; applied twice it changes nothing."""
    source = list(range(n))
    for a, b in pairs:
        source[a], source[b] = source[b], source[a]
    return g.flat([(-x, y, z) for x, y, z in (g.joint(flat, k) for k in source)])


#: Left and right joints of the 22-joint body.
BODY_PAIRS = ((1, 2), (4, 5), (7, 8), (10, 11), (13, 14), (16, 17), (18, 19), (20, 21))


def spine_frame(flat: Column) -> tuple[g.Vector, g.Vector, g.Vector]:
    """V-24: x along the spine, y across the hips, z = x cross y (not scaled), y = z cross x; used as rows."""
    x = g.unit(g.sub(g.joint(flat, 7), g.joint(flat, 0)))
    return _spine_axes(x, g.unit(g.sub(g.joint(flat, 4), g.joint(flat, 1))))


def _spine_axes(x: g.Vector, across: g.Vector) -> tuple[g.Vector, g.Vector, g.Vector]:
    z = g.cross(x, across)
    return x, g.cross(z, x), z


def to_root(flat: Column) -> Column:
    """V-25: joints 1.. as the transposed frame times (joint - root); the root stays."""
    root = g.joint(flat, 0)

    def turn(v: list[Column]) -> Column:
        columns = tuple((v[j], v[3 + j], v[6 + j]) for j in range(3))
        return g.flat([root, *[g.rotate(columns, g.sub(j, root)) for j in joints_of(flat)[1:]]])

    return _with_axes(flat, _spine_axes, (7, 0), (4, 1), turn)


def flip_siblings(flat: Column, joints: Sequence[int] = (4, 5, 6, 11, 12, 13)) -> Column:
    """V-26: some joints mirrored across the plane whose normal is the spine frame's second axis."""
    root = g.joint(flat, 0)

    def flip(v: list[Column]) -> Column:
        y, size = tuple(v[3:6]), g.dot(v[3:6], v[3:6])
        away = lambda j: g.scale(y, F.try_divide(2 * g.dot(g.sub(j, root), y), size))
        return g.flat([g.sub(j, away(j)) if k in joints else j for k, j in enumerate(joints_of(flat))])

    return _with_axes(flat, _spine_axes, (7, 0), (4, 1), flip)


def flip_average(a: Column, b: Column, n: int = JOINTS) -> Column:
    """V-39, the arithmetic part: mean of a prediction and the flipped prediction of the flipped input."""
    return F.array(*[(a[k] + b[k]) / 2 for k in range(3 * n)])


def zero_first_depth(frames: DataFrame, joints: str = "joints", clip: str = "clip") -> DataFrame:
    """V-39: the root's depth of each clip's first frame becomes 0."""
    first = F.row_number().over(W.partitionBy(clip).orderBy("frame")) == 1
    flat = F.col(joints)
    zeroed = F.concat(F.slice(flat, 1, 2), F.array(F.lit(0.0)), F.slice(flat, 4, 3 * JOINTS - 3))
    return frames.withColumn("__first", first).withColumn(joints, F.when(F.col("__first"), zeroed).otherwise(flat)).drop("__first")
