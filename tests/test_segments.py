import random

import pytest
from pyspark.sql import functions as F

from strideframe.operators import segments as s


def rows(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def segs(spark, *pairs, video="v"):
    return spark.createDataFrame([(video, a, b) for a, b in pairs], "video string, start long, end long")


def one(spark, n, fps=10.0):
    return spark.createDataFrame([("v", n, fps)], "video string, frames_number long, fps double")


def test_bins(spark):
    pairs = spark.createDataFrame([("v", k) for k in range(3)], "video string, pair_idx long")
    assert rows(s.pair_bins(pairs, one(spark, 75), 20)) == [(0, 39), (20, 59), (40, 74)]


def test_unite_is_strict_and_combine_touches(spark):
    assert rows(s.unite_overlapping(segs(spark, (0, 39), (20, 59), (60, 99)))) == [(0, 59), (60, 99)]
    assert rows(s.combine_adjacent(segs(spark, (0, 199), (200, 599)))) == [(0, 599)]


def test_duration_comes_before_combination(spark):
    given = segs(spark, (0, 39), (40, 79), (160, 219))
    assert rows(s.combine_adjacent(s.long_enough(given, 5, F.lit(10.0)))) == [(160, 219)]
    assert rows(s.long_enough(s.combine_adjacent(given), 5, F.lit(10.0))) == [(0, 79), (160, 219)]
    assert rows(s.long_enough(segs(spark, (0, 49), (100, 150)), 5, F.lit(10.0))) == [(100, 150)]


@pytest.mark.parametrize(
    ("given", "expected"),
    [([(10, 20), (30, 40)], [(0, 10), (20, 30), (40, 49)]), ([(0, 20), (30, 49)], [(20, 30)]), ([], [(0, 49)]), ([(0, 49)], [])],
)
def test_complement(spark, given, expected):
    frame = segs(spark, *given) if given else spark.createDataFrame([], "video string, start long, end long")
    assert rows(s.complement(frame, one(spark, 50))) == expected


def test_clip(spark):
    extent = spark.createDataFrame([("v", 150, 600)], "video string, first long, last long")
    found = s.clip_to(segs(spark, (100, 400)), extent, 120).collect()
    assert [(r["clip_start"], r["clip_end"]) for r in found] == [(150, 400)]


def test_compare(spark):
    a, b = segs(spark, (0, 10)), segs(spark, (2, 10))
    found = s.compare(s.numbered(a), s.numbered(b)).first()
    assert (found["mean_distance"], found["std_distance"]) == (1.0, 1.0)
    other = s.compare(s.numbered(a), s.numbered(segs(spark, (0, 3), (5, 10)))).first()
    assert other["mean_distance"] != other["mean_distance"]


def loop(pairs, joins):
    out = []
    last = None
    for a, b in pairs:
        if last is not None and joins(last, a):
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
        last = b
    return out


def test_unions_equal_a_sequential_loop(spark):
    rng = random.Random(3)
    data = []
    for v in range(60):
        at = 0
        for _ in range(rng.randint(1, 8)):
            at += rng.randint(0, 4)
            data.append((f"v{v}", at, at + rng.randint(0, 6)))
    df = spark.createDataFrame(data, "video string, start long, end long")
    for operator, joins in ((s.unite_overlapping, lambda e, a: e > a), (s.combine_adjacent, lambda e, a: e + 1 == a)):
        found = {}
        for r in operator(df).collect():
            found.setdefault(r["video"], []).append((r["start"], r["end"]))
        for v in {x[0] for x in data}:
            assert sorted(found[v]) == sorted(loop(sorted((a, b) for x, a, b in data if x == v), joins))


def test_no_pairs_give_no_segments(spark):
    pairs = spark.createDataFrame([], "video string, pair_idx long, dx long, dy long, confidence double")
    assert s.steady_segments(pairs, one(spark, 10)).count() == 0
