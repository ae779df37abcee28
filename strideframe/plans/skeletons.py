"""Queries of skeleton geometry and features over the embeddings table.

A row's first 51 numbers are a skeleton of 17 joints, its label the clip and
its vec_id the frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import features, pca, sequence, skeleton
from .relational import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def frames(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("joints"))


def J() -> Column:  # noqa: N802
    return F.col("joints")



def rounded(rows: DataFrame, *names: str, digits: int = 5) -> DataFrame:
    """Rounded, with -0 as 0, as engines print them apart."""
    return rows.withColumns({n: F.round(n, digits) + F.lit(0.0) for n in names})


def long(rows: DataFrame, values: Column, digits: int = 5) -> DataFrame:
    return rounded(rows.select("clip", "frame", F.posexplode(values).alias("pos", "v")), "v", digits=digits)


EM = "e AS (SELECT label AS clip, vec_id AS frame, embedding::DOUBLE[] AS j FROM embeddings)"


def p(k: int, i: int, source: str = "j") -> str:
    """Coordinate i of joint k."""
    return f"{source}[{3 * k + i + 1}]"


def bone(a: int, b: int) -> str:
    return "sqrt(" + " + ".join(f"({p(a, i)} - {p(b, i)}) * ({p(a, i)} - {p(b, i)})" for i in range(3)) + ")"


LEG = f"0.5 * ({bone(2, 1)} + {bone(3, 2)} + {bone(5, 4)} + {bone(6, 5)})"
SPINE, NECK = f"({bone(0, 7)} + {bone(7, 8)})", bone(10, 8)
HEIGHT = f"({LEG} + {SPINE} + {NECK})"


def sql_unit(name: str, a: int, b: int) -> str:
    return ", ".join(f"({p(a, i)} - {p(b, i)}) / {bone(a, b)} AS {name}{i}" for i in range(3))


def sql_cross(name: str, a: str, b: str) -> str:
    return ", ".join(f"{a}{i} * {b}{k} - {a}{k} * {b}{i} AS {name}{n}" for n, (i, k) in enumerate(((1, 2), (2, 0), (0, 1))))


AXES = f"""{EM}, a1 AS (SELECT *, {sql_unit("x", 4, 1)}, {sql_unit("u", 7, 0)} FROM e), a2 AS (SELECT *, {sql_cross("z", "x", "u")} FROM a1), a3 AS (SELECT *, {sql_cross("y", "x", "z")} FROM a2)"""


def r(expression: str, digits: int = 5) -> str:
    return f"round({expression}, {digits}) + 0.0"


# V-01..V-04
@query(f"WITH {EM} SELECT frame, {r(SPINE)} AS spine, {r(LEG)} AS leg, {r(NECK)} AS neck, {r(HEIGHT)} AS height FROM e")
def q24_heights(spark, sf_dir):
    rows = frames(spark, sf_dir).select("frame", skeleton.spine_length(J()).alias("spine"), skeleton.leg_length(J()).alias("leg"), skeleton.neck_head_length(J()).alias("neck"), skeleton.height(J()).alias("height"))
    return rounded(rows, "spine", "leg", "neck", "height")


MEANS = f"{EM}, h AS (SELECT *, {HEIGHT} AS h FROM e), c AS (SELECT clip, avg(h) AS m FROM h GROUP BY 1), t AS (SELECT avg(m) AS t, stddev_pop(m) AS s FROM c)"


# V-05, V-07, A-13
@query(f"WITH {MEANS} SELECT frame, {r('j[1] * t / m')} AS x0, {r('j[25] * t / m')} AS x8 FROM h JOIN c USING (clip), t")
def q25_height_align_avg(spark, sf_dir):
    rows = skeleton.align_heights(frames(spark, sf_dir)).select("frame", J()[0].alias("x0"), J()[24].alias("x8"))
    return rounded(rows, "x0", "x8")


# V-06
@query(f"WITH {MEANS} SELECT frame, {r('j[1] * t / h')} AS x0, {r('j[25] * t / h')} AS x8 FROM h, t")
def q26_height_align_frame(spark, sf_dir):
    rows = skeleton.align_heights(frames(spark, sf_dir), in_average=False).select("frame", J()[0].alias("x0"), J()[24].alias("x8"))
    return rounded(rows, "x0", "x8")


# A-13, A-14
@query(f"WITH {MEANS} SELECT {r('t', 6)} AS mean_height, {r('s', 6)} AS std_height FROM t")
def q26b_height_statistics(spark, sf_dir):
    return rounded(skeleton.height_statistics(frames(spark, sf_dir)), "mean_height", "std_height", digits=6)


# V-08, V-12
@query(f"""WITH {AXES} SELECT frame, {", ".join(f"{r(a + str(i))} AS {a}{i}" for a in "xyz" for i in range(3))}, {r("x2 * 0.6 + y2 * 0.3 + z2 * 0.1")} AS facing FROM a3""")
def q27_root_frame(spark, sf_dir):
    axes = skeleton.root_frame(J())
    names = [f"{a}{i}" for a in "xyz" for i in range(3)]
    facing = skeleton.features(J(), g.vector(0.6, 0.3, 0.1))[3]
    rows = frames(spark, sf_dir).select("frame", *[v.alias(n) for n, v in zip(names, [x for a in axes for x in a], strict=True)], facing.alias("facing"))
    return rounded(rows, *names, "facing")


def sql_long(source: str, parts: list[str]) -> str:
    return f"SELECT clip, frame, pos::INT AS pos, {r('v')} AS v FROM (SELECT clip, frame, unnest(range({len(parts)})) AS pos, unnest([{', '.join(parts)}]) AS v FROM {source})"


def sql_aligned(k: int, a: str) -> str:
    return "(" + " + ".join(f"({p(k, i)} - {p(0, i)}) * {a}{i}" for i in range(3)) + ")"


# V-09, V-10
@query(f"WITH {AXES} {sql_long('a3', [p(0, i) for i in range(3)] + [sql_aligned(k, a) for k in range(1, 17) for a in 'xyz'])}")
def q28_global_align(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.align_globally(J()))


# V-11
@query(f"WITH {EM} {sql_long('e', [f'{p(k, i)} - {p(0, i)}' for k in range(17) for i in range(3)])}")
def q28b_origin(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.shift_to_origin(J()))


# V-14, P-23, D17
@query(f"WITH {EM} {sql_long('e', [f'j[{k}]' for k in range(1, 52) if k != 3])}")
def q29_stack(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.stacked(J()))


# F-28
@query(f"WITH {EM} {sql_long('e', ['0.0', '0.0', '0.0'] + [f'j[{k}]' for k in range(1, 49)])}")
def q29b_zero_root(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.with_zero_root(F.slice(J(), 1, 49)))


STATS = f"""{EM}, l AS (SELECT unnest(range(51)) AS pos, unnest(j[1:51]) AS v FROM e), s AS (SELECT pos, avg(v) AS mean, stddev_pop(v) AS std FROM l GROUP BY 1)"""


# A-15, A-16, D20
@query(f"""WITH {STATS} SELECT pos::INT AS pos, {r("mean", 6)} AS mean, {r("avg(std) OVER (PARTITION BY pos // 10)", 6)} AS std FROM s""")
def q30_feature_stats(spark, sf_dir):
    stats = features.feature_statistics(frames(spark, sf_dir).select(F.slice(J(), 1, 51).alias("values")))
    return rounded(features.pooled_deviation(stats, F.floor(F.col("pos") / 10)), "mean", "std", digits=6)


PAIRS = ((1, 2), (4, 5), (7, 8), (10, 11), (13, 14), (16, 17), (18, 19))


def _mirror(n: int) -> list[str]:
    source = list(range(n))
    for a, b in PAIRS:
        source[a], source[b] = source[b], source[a]
    return [("-" if i == 0 else "") + p(k, i) for k in source for i in range(3)]


# F-29, F-31, P-24
@query(f"WITH {EM} {sql_long('e', _mirror(21))}")
def q31_mirror(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.mirrored(skeleton.subset(J(), 21), PAIRS, 21))


# W-11, W-12
@query(f"""WITH {EM}, s AS (SELECT clip, frame, j[1] - lag(j[1]) OVER w AS d_x, pow(lead(j[10]) OVER w - j[10], 2) + pow(lead(j[11]) OVER w - j[11], 2) + pow(lead(j[12]) OVER w - j[12], 2) AS s FROM e WINDOW w AS (PARTITION BY clip ORDER BY frame))
SELECT clip, frame, {r("d_x")} AS d_x, CASE WHEN s < 0.04 THEN 1.0 ELSE 0.0 END::DOUBLE AS contact FROM s WHERE s IS NOT NULL AND d_x IS NOT NULL""")
def q32_velocity_contact(spark, sf_dir):
    rows = frames(spark, sf_dir).select("clip", "frame", J()[0].alias("x"), J()[9].alias("a"), J()[10].alias("b"), J()[11].alias("c"))
    found = sequence.first_difference(sequence.contact(rows, "a", "b", "c", 0.04), "x")
    return rounded(found.select("clip", "frame", "d_x", "contact"), "d_x")


# V-29, A-18, W-14
@query(f"""WITH {EM}, w AS (SELECT *, min(list_min([{", ".join(p(k, 1) for k in range(17))}])) OVER (PARTITION BY clip) AS y0,
  first_value(j[1]) OVER (PARTITION BY clip ORDER BY frame) AS x0, first_value(j[3]) OVER (PARTITION BY clip ORDER BY frame) AS z0 FROM e)
SELECT clip, frame, {r("j[4] - x0")} AS x1, {r("j[5] - y0")} AS y1, {r("j[6] - z0")} AS z1 FROM w""")
def q32b_floor(spark, sf_dir):
    rows = features.put_on_floor(frames(spark, sf_dir), n=17).select("clip", "frame", J()[3].alias("x1"), J()[4].alias("y1"), J()[5].alias("z1"))
    return rounded(rows, "x1", "y1", "z1")


# V-35, W-13
@query(f"""WITH {EM}, h AS (SELECT clip, frame, coalesce(sum(j[1]) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
  coalesce(lag(j[2]) OVER w, 0) AS vx, coalesce(lag(j[3]) OVER w, 0) AS vz FROM e WINDOW w AS (PARTITION BY clip ORDER BY frame)),
t AS (SELECT *, vx * cos(2 * a) - vz * sin(2 * a) AS x, vz * cos(2 * a) + vx * sin(2 * a) AS z FROM h)
SELECT clip, frame, {r("a")} AS heading, {r("sum(x) OVER u")} AS root_x, {r("sum(z) OVER u")} AS root_z FROM t WINDOW u AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING)""")
def q33b_recover_root(spark, sf_dir):
    rows = frames(spark, sf_dir).select("clip", "frame", J()[0].alias("rv"), J()[1].alias("vx"), J()[2].alias("vz"), J()[3].alias("y"))
    return rounded(features.recover_root(rows).select("clip", "frame", "heading", "root_x", "root_z"), "heading", "root_x", "root_z")


# V-36
@query(f"""WITH {EM} SELECT frame, {r("j[1] * cos(2 * j[5]) - j[3] * sin(2 * j[5]) + j[7]")} AS x1, {r("j[2]")} AS y1, {r("j[3] * cos(2 * j[5]) + j[1] * sin(2 * j[5]) + j[9]")} AS z1, {r("j[8]")} AS y0 FROM e""")
def q33c_recover_positions(spark, sf_dir):
    out = features.recover_positions(F.slice(J(), 1, 3), J()[4], (J()[6], J()[7], J()[8]), n=2)
    rows = frames(spark, sf_dir).select("frame", out.alias("o")).select("frame", F.col("o")[3].alias("x1"), F.col("o")[4].alias("y1"), F.col("o")[5].alias("z1"), F.col("o")[1].alias("y0"))
    return rounded(rows, "x1", "y1", "z1", "y0")


SPINE_AXES = f"""{EM}, b1 AS (SELECT *, {sql_unit("x", 7, 0)}, {sql_unit("u", 4, 1)} FROM e), b2 AS (SELECT *, {sql_cross("z", "x", "u")} FROM b1), b3 AS (SELECT *, {sql_cross("y", "z", "x")} FROM b2)"""


# V-24, V-25
@query(f"""WITH {SPINE_AXES} {sql_long("b3", [p(0, i) for i in range(3)] + ["(" + " + ".join(f"({p(k, i)} - {p(0, i)}) * {a}{c}" for i, a in enumerate("xyz")) + ")" for k in range(1, 17) for c in range(3)])}""")
def q45_to_root(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.to_root(J()))


def _flip(k: int, i: int) -> str:
    if k not in (4, 5, 6, 11, 12, 13):
        return p(k, i)
    along = " + ".join(f"({p(k, c)} - {p(0, c)}) * y{c}" for c in range(3))
    return f"{p(k, i)} - 2 * ({along}) * y{i} / (y0 * y0 + y1 * y1 + y2 * y2)"


# V-26
@query(f"WITH {SPINE_AXES} {sql_long('b3', [_flip(k, i) for k in range(17) for i in range(3)])}")
def q46_flip_siblings(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.flip_siblings(J()), digits=5)


# V-39
@query(f"WITH {EM} {sql_long('e', [f'(j[{k}] + j[{k + 1}]) / 2' for k in range(1, 52)])}")
def q47_flip_average(spark, sf_dir):
    return long(frames(spark, sf_dir), skeleton.flip_average(J(), F.slice(J(), 2, 51)))


# P-19, A-19
@query(f"""WITH {EM}, b AS (SELECT DISTINCT clip FROM e WHERE j[1] > 0.4), k AS (SELECT * FROM e WHERE clip NOT IN (SELECT clip FROM b))
SELECT count(DISTINCT clip) AS clips, count(*) AS frames, round(count(*) / 40.0::DOUBLE / 60, 6) AS minutes FROM k""")
def q48_totals(spark, sf_dir):
    marked = frames(spark, sf_dir).withColumn("values", F.array(F.when(J()[0] > 0.4, F.lit(float("nan"))).otherwise(J()[0])))
    return features.totals(features.finite_clips(marked)).withColumn("minutes", F.round("minutes", 6))


#: Heading of a skeleton of 21 joints: (fx, fz), the level direction at right angles to hips and shoulders.
def sql_heading(j: str) -> str:
    ax, az = (f"({p(2, i, j)} - {p(1, i, j)} + {p(17, i, j)} - {p(16, i, j)})" for i in (0, 2))
    size = f"sqrt({ax} * {ax} + {az} * {az})"
    return f"{az} / {size} AS fx, -{ax} / {size} AS fz"


def sql_turned(x: str, z: str, f: str = "") -> tuple[str, str]:
    """x and z after a turn about y that takes the heading to +z."""
    return f"(({x}) * {f}fz - ({z}) * {f}fx)", f"(({x}) * {f}fx + ({z}) * {f}fz)"


def sql_placed(x0: str = "0", y0: str = "0", z0: str = "0", j: str = "j", f: str = "") -> str:
    """21 joints minus an origin, turned."""
    parts = []
    for k in range(21):
        x, z = sql_turned(f"{p(k, 0, j)} - {x0}", f"{p(k, 2, j)} - {z0}", f)
        parts += [x, f"{p(k, 1, j)} - {y0}", z]
    return f"[{', '.join(parts)}]"


FIRST = f"{EM}, e0 AS (SELECT *, first_value(j) OVER (PARTITION BY clip ORDER BY frame) AS j0 FROM e), e1 AS (SELECT *, {sql_heading('j0')} FROM e0)"


# V-13, V-27, V-28, V-31
@query(f"""WITH {FIRST}, e2 AS (SELECT clip, frame, {sql_placed()} AS j FROM e1), e3 AS (SELECT *, {sql_heading('j')} FROM e2), e4 AS (SELECT clip, frame, {sql_placed('j[1]', '0', 'j[3]')} AS j FROM e3)
SELECT clip, frame, unnest(range(63))::INT AS pos, {r("unnest(j)", 6)} AS v FROM e4""")
def q49_rotations(spark, sf_dir):
    """Face-forward clips and their local poses; lengths are unchanged by rotations."""
    turned = features.face_forward(frames(spark, sf_dir).withColumn("joints", F.slice(J(), 1, 63)), n=21)
    headed = turned.withColumn("q", features.facing(J()))
    rows = headed.select("clip", "frame", F.posexplode(features.local_pose(J(), features.quaternion(F.col("q")), n=21)).alias("pos", "v"))
    return rounded(rows, "v", digits=6)


# V-15, V-16
@query()
def q41_pca(spark, sf_dir):
    rows = frames(spark, sf_dir).select("clip", "frame", skeleton.stacked(J()).alias("values"))
    return pca.fit_component(rows).transform(rows).select("clip", "frame", F.round("score", 6).alias("score"))


_LEG = lambda shift: " + ".join("greatest(" + ", ".join(f"abs(j[{3 * k + i + 1 + shift}])" for i in range(3)) + ")" for k in (5, 8))


# V-33, A-21, P-24
@query(f"WITH {EM} SELECT clip, frame, 64 AS width, {r(f'({_LEG(3)}) / ({_LEG(0)})', 6)} AS ratio FROM e")
def q50_assembly(spark, sf_dir):
    whole = features.assemble(F.slice(J(), 1, 4), F.slice(J(), 5, 20), F.slice(J(), 25, 20), F.slice(J(), 45, 16), F.slice(J(), 61, 4))
    return frames(spark, sf_dir).select("clip", "frame", F.size(whole).alias("width"), F.round(features.leg_ratio(J(), F.slice(J(), 4, 48)), 6).alias("ratio"))


_FEATURES = f"""{FIRST}, e2 AS (SELECT *, min(list_min([{", ".join(p(k, 1) for k in range(21))}])) OVER (PARTITION BY clip) AS y0 FROM e1),
f0 AS (SELECT clip, frame, j AS raw, {sql_placed("j0[1]", "y0", "j0[3]")} AS j FROM e2), f1 AS (SELECT *, {sql_heading("j")} FROM f0),
f2 AS (SELECT *, lead(j) OVER w AS k, lead(fx) OVER w AS gx, lead(fz) OVER w AS gz FROM f1 WINDOW w AS (PARTITION BY clip ORDER BY frame)),
f3 AS (SELECT *, asin(sin((atan2(-gx, gz) - atan2(-fx, fz)) / 2)) AS rv, (k[1] - j[1]) * gz - (k[3] - j[3]) * gx AS vx, (k[1] - j[1]) * gx + (k[3] - j[3]) * gz AS vz,
  {sql_placed("j[1]", "0", "j[3]")}[4:63] AS ric, [{", ".join(f"k[{i}] - j[{i}]" for i in range(1, 64))}] AS d FROM f2 WHERE k IS NOT NULL)"""
_CONTACTS = ", ".join(f"CASE WHEN {' + '.join(f'{p(k, i, chr(100))} * {p(k, i, chr(100))}' for i in range(3))} < 0.05 THEN 1.0::DOUBLE ELSE 0 END" for k in (7, 10, 8, 11))


def feature_rows(spark, sf_dir) -> DataFrame:
    """Rows of 21 joints; a frame's own numbers, twice, stand for its rotation block."""
    body = F.slice(J(), 1, 60)
    return features.motion_features(frames(spark, sf_dir).withColumn("rotations", F.concat(body, body)), n=21, standing=0.05)


# V-34, V-28..V-33
@query(f"""WITH {_FEATURES}, f4 AS (SELECT clip, frame, list_concat([rv, vx, vz, j[2]], ric, raw[1:60], raw[1:60], {sql_placed(j="d")}, [{_CONTACTS}]) AS v FROM f3)
SELECT clip, frame, unnest(range(251))::INT AS pos, {r("unnest(v)")} AS v FROM f4""")
def q69_motion_features(spark, sf_dir):
    return long(feature_rows(spark, sf_dir), F.col("values"))


_BACK = ["rx", "y", "rz"]
for _k in range(20):
    _x, _y, _z = (f"ric[{3 * _k + _i + 1}]" for _i in range(3))
    _BACK += [f"{_x} * cos(2 * a) - {_z} * sin(2 * a) + rx", _y, f"{_z} * cos(2 * a) + {_x} * sin(2 * a) + rz"]


# V-35, V-36 of V-34; a turn by more than half a circle in one frame is taken for a smaller one, as its sine is all that is kept
@query(f"""WITH {_FEATURES}, h AS (SELECT clip, frame, ric, j[2] AS y, coalesce(sum(rv) OVER (PARTITION BY clip ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a,
  coalesce(lag(vx) OVER w, 0) AS vx, coalesce(lag(vz) OVER w, 0) AS vz FROM f3 WINDOW w AS (PARTITION BY clip ORDER BY frame)),
t AS (SELECT *, vx * cos(2 * a) - vz * sin(2 * a) AS x, vz * cos(2 * a) + vx * sin(2 * a) AS z FROM h), u AS (SELECT *, sum(x) OVER o AS rx, sum(z) OVER o AS rz FROM t WINDOW o AS (PARTITION BY clip ORDER BY frame ROWS UNBOUNDED PRECEDING))
SELECT clip, frame, unnest(range(63))::INT AS pos, {r(f"unnest([{', '.join(_BACK)}])", 4)} AS v FROM u""")
def q70_recovered_clips(spark, sf_dir):
    return long(features.recovered(feature_rows(spark, sf_dir), n=21), J(), digits=4)


_SOURCES = "('Eyes_Japan_Dataset/', 'humanact12/', 'BMLmovi/')"


# X-19, P-25, F-29
@query(f"""WITH {EM}, s AS (SELECT *, list_extract([{_SOURCES[1:-1]}], (clip % 3 + 1)::INT) || clip AS source, row_number() OVER (PARTITION BY clip ORDER BY frame) - 1 AS i FROM e),
x AS (SELECT DISTINCT source, 'c' || clip AS name, 2 + clip AS lo, 40 + 9 * clip AS hi FROM s WHERE clip IS NOT NULL UNION SELECT DISTINCT source, 'd' || clip, 30, 90 FROM s WHERE clip IS NOT NULL),
b AS (SELECT *, source LIKE '%humanact12%' AS whole, CASE WHEN source LIKE '%Eyes_Japan_Dataset%' THEN 120 ELSE 0 END AS skip FROM x),
c AS (SELECT name, CASE WHEN whole THEN i ELSE i - skip - 2 * lo END AS frame, CASE WHEN whole THEN 1 ELSE -1 END AS side, j FROM s JOIN b USING (source) WHERE whole OR (i >= skip + 2 * lo AND i < skip + 2 * hi))
SELECT name AS clip, frame, {r("side * j[1]")} AS x0, {r("side * j[4]")} AS x1, {r("j[5]")} AS y1 FROM c UNION ALL SELECT 'M' || name, frame, {r("-side * j[1]")}, {r("-side * j[7]")}, {r("j[8]")} FROM c""")
def q71_augmented_clips(spark, sf_dir):
    rows = frames(spark, sf_dir).where("clip IS NOT NULL")
    kinds = F.array(F.lit("Eyes_Japan_Dataset/"), F.lit("humanact12/"), F.lit("BMLmovi/"))
    named = sequence.frame_index(rows.withColumnRenamed("frame", "id"), "clip", "id").withColumn("source", F.concat(F.get(kinds, (F.col("clip") % 3).cast("int")), F.col("clip").cast("string")))
    listed = named.select("source", "clip").distinct()
    c = F.col("clip")
    cuts = F.array(
        F.struct(F.concat(F.lit("c"), c.cast("string")).alias("name"), (2 + c).cast("long").alias("start"), (40 + 9 * c).cast("long").alias("end")),
        F.struct(F.concat(F.lit("d"), c.cast("string")).alias("name"), F.lit(30).cast("long").alias("start"), F.lit(90).cast("long").alias("end")),
    )
    out = features.augmented(named, listed.select("source", F.inline(cuts)), n=21, pairs=PAIRS)
    return rounded(out.select("clip", "frame", J()[0].alias("x0"), J()[3].alias("x1"), J()[4].alias("y1")), "x0", "x1", "y1")
