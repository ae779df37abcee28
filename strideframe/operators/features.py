"""Motion features from joint sequences (V-28, V-29, V-31, V-33..V-36, A-15, A-16, A-18, A-19, A-21, P-19, X-19).

Inverse and forward kinematics need body models that are not available, so
rotation blocks are taken as input where they occur.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import geometry as g
from . import skeleton


def put_on_floor(frames: DataFrame, joints: str = "joints", clip: str = "clip", n: int = 22) -> DataFrame:
    """V-29, A-18, W-14: minus the clip's lowest y, and the first frame's root x and z."""
    flat = F.col(joints)
    low = F.min(F.least(*[flat[3 * k + 1] for k in range(n)])).over(W.partitionBy(clip))
    first = W.partitionBy(clip).orderBy("frame")
    x0, z0 = F.first(flat[0]).over(first), F.first(flat[2]).over(first)
    moved = frames.withColumns({"__y": low, "__x": x0, "__z": z0})
    shifted = [g.sub(g.joint(flat, k), (F.col("__x"), F.col("__y"), F.col("__z"))) for k in range(n)]
    return moved.withColumn(joints, g.flat(shifted)).select(*frames.columns)


def facing(flat: Column, hips: tuple[int, int] = (2, 1), shoulders: tuple[int, int] = (17, 16)) -> Column:
    """V-28: the quaternion (array of 4) that turns the body's forward direction to +z."""
    across = g.add(g.sub(g.joint(flat, hips[0]), g.joint(flat, hips[1])), g.sub(g.joint(flat, shoulders[0]), g.joint(flat, shoulders[1])))

    def turn(forward: list[Column]) -> Column:
        return F.array(*g.quaternion_between(tuple(forward), g.vector(0.0, 0.0, 1.0)))

    return g.let(across, lambda v: g.let(g.unit(g.cross(g.vector(0.0, 1.0, 0.0), tuple(v))), turn))


def quaternion(values: Column) -> g.Quaternion:
    return tuple(values[k] for k in range(4))


def face_forward(frames: DataFrame, joints: str = "joints", clip: str = "clip", n: int = 22) -> DataFrame:
    """V-28: all frames of a clip turned by the quaternion of its first frame."""
    first = W.partitionBy(clip).orderBy("frame")
    turned = frames.withColumn("__f", facing(F.col(joints))).withColumn("__q", F.first("__f").over(first))
    moved = g.each_joint(F.col(joints), n, lambda j: g.quaternion_rotate(quaternion(F.col("__q")), j))
    return turned.withColumn(joints, moved).select(*frames.columns)


def local_pose(flat: Column, q: g.Quaternion, n: int = 22) -> Column:
    """V-31: joints minus the root's x and z, turned by the root's quaternion."""
    root = (flat[0], F.lit(0.0), flat[2])
    return g.each_joint(flat, n, lambda j: g.quaternion_rotate(q, g.sub(j, root)))


def assemble(root: Column, positions: Column, rotations: Column, velocities: Column, contacts: Column) -> Column:
    """V-33, D19: one array in the order root, positions, rotations, velocities, contacts."""
    return F.concat(root, positions, rotations, velocities, contacts)


#: Ankles and toes, left before right, and the squared step below which a foot stands.
FEET, STANDING = (7, 10, 8, 11), 0.002


def motion_features(frames: DataFrame, joints: str = "joints", rotations: str = "rotations", clip: str = "clip", n: int = 22, standing: float = STANDING) -> DataFrame:
    """V-34: clip, frame and `values` (V-33), 8 + 9 (n - 1) + 3 n numbers, for each frame but a clip's last.

    A clip is put on the floor with its first root at the origin and turned so
    that its first frame faces +z. The root block is the half angle turned
    until the next frame, the root's step seen from the next frame's heading
    (x, z), and its height; then local positions, the rotation block (6 (n - 1)
    numbers of `rotations`, taken as it is), local velocities, and whether the
    feet stand. All windows share one exchange and one sort on (clip, frame).
    Frames without a number or with fewer than n joints are left out first; a
    frame without rotations, or whose hips and shoulders give no heading, has
    null values. A clip of one frame has no rows.
    """
    line = W.partitionBy(clip).orderBy("frame")
    whole = line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    flat, at = F.col("__j"), F.col("__p")
    lean = frames.where((F.size(joints) >= 3 * n) & F.col("frame").isNotNull())
    lean = lean.select(clip, "frame", F.col(joints).cast("array<double>").alias("__j"), F.col(rotations).cast("array<double>").alias("__r"))
    lowest = F.least(*[flat[3 * k + 1] for k in range(n)])
    known = lean.withColumns({"__y": F.min(lowest).over(whole), "__first": F.first("__j").over(whole)}).withColumn("__q", facing(F.col("__first")))
    origin = (F.col("__first")[0], F.col("__y"), F.col("__first")[2])
    placed = g.each_joint(flat, n, lambda j: g.quaternion_rotate(quaternion(F.col("__q")), g.sub(j, origin)))
    headed = known.select(clip, "frame", "__r", placed.alias("__p")).withColumn("__q", facing(at))
    paired = headed.withColumns({"__to": F.lead("__p").over(line), "__turned": F.lead("__q").over(line)}).where(F.col("__to").isNotNull())
    now, after = quaternion(F.col("__q")), quaternion(F.col("__turned"))
    turn = g.quaternion_multiply(after, g.quaternion_inverse(now))[2]
    local = F.slice(local_pose(at, now, n), 4, 3 * (n - 1))

    def row(step: Column) -> Column:
        x, _, z = g.quaternion_rotate(after, g.joint(step, 0))
        root = F.array(F.asin(g.clip(turn, -1.0, 1.0)), x, z, at[1])
        velocities = g.each_joint(step, n, lambda j: g.quaternion_rotate(now, j))
        contacts = F.array(*[F.when(g.dot(g.joint(step, k), g.joint(step, k)) < standing, 1.0).otherwise(0.0) for k in FEET])
        return assemble(root, local, F.col("__r"), velocities, contacts)

    # the steps are bound inside one expression, so that a filter on it, pushed below it, makes them once and not at each use
    values = F.transform(F.array(F.zip_with("__to", "__p", lambda b, a: b - a)), row)[0]
    usable = F.col("__q")[0].isNotNull() & F.col("__turned")[0].isNotNull()
    return paired.select(clip, "frame", F.when(usable, values).alias("values"))


def recovered(rows: DataFrame, values: str = "values", clip: str = "clip", n: int = 22) -> DataFrame:
    """V-35 with V-36: clip, frame and `joints`, from the root and position blocks of motion features."""
    block = F.col(values)
    parts = rows.select(clip, "frame", *[block[k].alias(name) for k, name in enumerate(("rv", "vx", "vz", "y"))], F.slice(block, 5, 3 * (n - 1)).alias("__local"))
    rooted = recover_root(parts, clip)
    root = (F.col("root_x"), F.col("root_y"), F.col("root_z"))
    return rooted.select(clip, "frame", recover_positions(F.col("__local"), F.col("heading"), root, n).alias("joints"))


#: Seconds cut from the start of recordings of some collections, by a part of their path (K-19: 40 fps).
LEADS = {"Eyes_Japan_Dataset": 3.0, "MPI_HDM05": 3.0, "TotalCapture": 1.0, "MPI_Limits": 1.0, "Transitions_mocap": 0.5}
#: Fixed value: recordings with this in their path are taken whole and not turned.
WHOLE = "humanact12"
#: Frames of a block by which recordings meet the index.
BLOCK = 1024


def augmented(frames: DataFrame, index: DataFrame, joints: str = "joints", n: int = 22, pairs: Sequence[tuple[int, int]] = skeleton.BODY_PAIRS, rate: int = 40, index_rate: int = 20) -> DataFrame:
    """X-19 (second step): clips cut from recordings by an index, and their mirror images, named with an M before.

    frames: source, frame (from 0), joints. index: source, name, start, end, at
    index_rate, end exclusive. Gives clip, frame (from 0), joints. Bounds count
    from the end of the recording's lead; x is negated. The join is on the
    source and a block of frames, so a long recording with many clips does not
    meet them all. Rows without a source, and clips without frames, give none.
    """
    source, up = F.col("source"), rate / index_rate
    lead = sum((F.when(source.contains(part), F.lit(int(seconds * rate))).otherwise(0) for part, seconds in LEADS.items()), F.lit(0))
    whole = source.contains(WHOLE)
    lean = frames.select("source", "frame", F.slice(joints, 1, 3 * n).cast("array<double>").alias("__j"))
    bounds = index.select("source", "name", *[(F.col(x) * up).cast("long").alias(f"__{x}") for x in ("start", "end")])
    low, high = F.col("__start") + lead, F.col("__end") + lead
    cut = bounds.where(~whole).withColumns({"__low": low, "__high": high}).where("__high > __low")
    spread = cut.withColumn("__block", F.explode(F.sequence(F.floor(F.col("__low") / BLOCK), F.floor((F.col("__high") - 1) / BLOCK))))
    cuts = lean.withColumn("__block", F.floor(F.col("frame") / BLOCK)).join(spread, ["source", "__block"]).where("frame >= __low AND frame < __high")
    turned = F.transform("__j", lambda x, k: F.when(k % 3 == 0, -x).otherwise(x))
    cuts = cuts.select("name", (F.col("frame") - F.col("__low")).alias("frame"), turned.alias("__j"))
    uncut = lean.join(bounds.where(whole).select("source", "name"), "source").select("name", F.col("frame").cast("long").alias("frame"), "__j")
    both = F.array(F.struct(F.col("name").alias("clip"), F.col("__j").alias("joints")), F.struct(F.concat(F.lit("M"), "name").alias("clip"), skeleton.mirrored(F.col("__j"), pairs, n).alias("joints")))
    return cuts.unionByName(uncut).select("frame", F.inline(both)).select("clip", "frame", "joints")


def finite_clips(frames: DataFrame, values: str = "values", clip: str = "clip") -> DataFrame:
    """P-19: clips none of whose values is NaN."""
    bad = frames.groupBy(clip).agg(F.bool_or(F.exists(F.col(values), F.isnan)).alias("bad")).where("bad").select(clip)
    return frames.join(bad, clip, "left_anti")


def feature_statistics(frames: DataFrame, values: str = "values") -> DataFrame:
    """A-15, D20: by position, mean and population deviation over all frames."""
    long = frames.select(F.posexplode(values).alias("pos", "v"))
    return long.groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def pooled_deviation(stats: DataFrame, block: Column) -> DataFrame:
    """A-16: deviations replaced by their block's mean."""
    return stats.withColumn("__b", block).withColumn("std", F.avg("std").over(W.partitionBy("__b"))).drop("__b")


#: First positions of the blocks of the 263-wide features of 22 joints.
BLOCKS = (0, 1, 3, 4, 67, 193, 259)


def block_of(pos: Column, starts: Sequence[int] = BLOCKS) -> Column:
    out = F.lit(0)
    for k, start in enumerate(starts):
        out = F.when(pos >= start, F.lit(k)).otherwise(out)
    return out


def recover_root(frames: DataFrame, clip: str = "clip") -> DataFrame:
    """V-35, W-13: heading and root position from rotation velocity (rv), local velocity (vx, vz) and height (y).

    The heading at a frame is the sum of the velocities before it; its
    quaternion is (cos, 0, sin, 0) of that angle. Velocities are turned back by
    it and summed.
    """
    w = W.partitionBy(clip).orderBy("frame")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    headed = frames.withColumn("heading", F.coalesce(F.sum("rv").over(before), F.lit(0.0)))
    shifted = headed.withColumns({"__vx": F.coalesce(F.lag("vx").over(w), F.lit(0.0)), "__vz": F.coalesce(F.lag("vz").over(w), F.lit(0.0))})
    q = (F.cos("heading"), F.lit(0.0), -F.sin("heading"), F.lit(0.0))
    x, _, z = g.quaternion_rotate(q, (F.col("__vx"), F.lit(0.0), F.col("__vz")))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    turned = shifted.withColumns({"__x": x, "__z": z})
    return turned.withColumns({"root_x": F.sum("__x").over(upto), "root_y": F.col("y"), "root_z": F.sum("__z").over(upto)}).drop("__vx", "__vz", "__x", "__z")


def recover_positions(local: Column, heading: Column, root: g.Vector, n: int = 22) -> Column:
    """V-36: joints 1.. turned by the inverse heading and moved to the root's x and z, the root before them."""
    def back(v: list[Column]) -> Column:
        q, ahead = (v[0], F.lit(0.0), -v[1], F.lit(0.0)), (v[2], F.lit(0.0), v[3])
        return g.each_joint(local, n - 1, lambda j: g.add(g.quaternion_rotate(q, j), ahead))

    return F.concat(F.array(*root), g.let((F.cos(heading), F.sin(heading), root[0], root[2]), back))


def leg_ratio(source: Column, target: Column, bones: Sequence[int] = (5, 8)) -> Column:
    """A-21: greatest absolute offset of two leg bones, target over source; arrays of offsets, flat."""
    size = lambda flat: sum((F.greatest(*[F.abs(x) for x in g.joint(flat, k)]) for k in bones[1:]), F.greatest(*[F.abs(x) for x in g.joint(flat, bones[0])]))
    return F.try_divide(size(target), size(source))


def totals(frames: DataFrame, clip: str = "clip", fps: int = 40) -> DataFrame:
    """A-19: clips, frames and minutes at the true frame rate (K-19)."""
    return frames.agg(F.count_distinct(clip).alias("clips"), F.count(F.lit(1)).alias("frames"), (F.count(F.lit(1)) / F.lit(fps) / F.lit(60)).alias("minutes"))
