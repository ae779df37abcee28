"""Overlaps of tracks and what is found by them: by brute force or SQL, over several blocks and words, and with no pair exchanged."""

import random

import duckdb
import pytest

import __spark_entry__ as driver
from strideframe.operators import tracks

SCHEMA = "video string, track long, frame long"


def made(videos=3, each=30, frames=400, seed=1):
    """Tracks of many lengths and places, with frames below 0, listed twice and null, and keys that are null."""
    dice = random.Random(seed)
    rows = []
    for v in range(videos):
        for t in range(each):
            at, n = dice.randrange(-frames, frames), dice.choice([1, 3, 40, 150])
            rows += [(f"v{v}", t * 7 - 20, f) for f in range(at, at + n) if dice.random() < 0.9]
            rows += [rows[-1], (f"v{v}", t * 7 - 20, None)][: dice.randrange(3)] if rows else []
    rows += [("v0", 900, 10**12), ("v0", 901, 10**12), ("v1", 902, None), ("v1", None, 5), (None, 7, 5), ("w", 1, 1)]
    dice.shuffle(rows)
    return rows


def brute(rows):
    """Share of a track's frames; a null frame counts as one that meets none."""
    sets = {}
    for video, track, frame in rows:
        if video is not None and track is not None:
            sets.setdefault((video, track), set()).add(frame)
    out = {}
    for (v, a), x in sets.items():
        for (w, b), y in sets.items():
            if v == w and a != b and (common := (x & y) - {None}):
                out[v, a, b] = len(common) / len(x)
    return out


def exchanged(df):
    """Rows that a query wrote to exchanges."""
    df.collect()

    def walk(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            return walk(node.plan())
        own = node.metrics().get("shuffleRecordsWritten")
        below = node.children()
        return (own.get().value() if own.isDefined() else 0) + sum(walk(below.apply(k)) for k in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize(("block", "cells"), [(8, 16), (1024, 1 << 17)])
def test_overlaps_by_brute_force(spark, monkeypatch, block, cells):
    monkeypatch.setattr(tracks, "PAIRED", block)
    monkeypatch.setattr(tracks, "CELLS", cells)
    monkeypatch.setattr(tracks, "LONG", 2)
    rows = made()
    found = tracks.overlaps(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(found) == len(want) > 300
    assert {(r["video"], r["track"], r["other"]): r["overlap"] for r in found} == want


def test_overlaps_of_other_keys_and_none(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 5), (1, "b", 6)], "clip int, person string, frame int")
    found = tracks.overlaps(df, ("clip", "person"))
    assert found.columns == ["clip", "person", "other", "overlap"]
    assert sorted(map(tuple, found.collect())) == [(1, "a", "b", 1.0), (1, "b", "a", 0.5)]
    assert tracks.overlaps(df.where("frame > 5"), ("clip", "person")).collect() == []


def crowd(spark, each=150, frames=40):
    rows = [("v", t, f) for t in range(each) for f in range(frames) if (t + f) % 11]
    return spark.createDataFrame(rows, SCHEMA), len(rows)


def test_overlaps_exchange_no_pairs(spark):
    df, n = crowd(spark)
    assert exchanged(tracks.overlaps(df)) < n + 4 * 150 + 2 * 150  # frames, their words in each of 4 tasks, tracks


@pytest.mark.parametrize(("block", "cells", "most"), [(8, 16, 0.05), (8, 64, 0.5), (4096, 1 << 17, 0.5), (8, 64, -1.0), (8, 64, 1.0)])
def test_single_person_by_brute_force(spark, monkeypatch, block, cells, most):
    monkeypatch.setattr(tracks, "SEARCHED", block)
    monkeypatch.setattr(tracks, "CELLS", cells)
    monkeypatch.setattr(tracks, "LONG", 2)
    rows = made()
    bad = {(v, a) for (v, a, _), share in brute(rows).items() if share > most}
    found = [(r["video"], r["track"]) for r in tracks.single_person(spark.createDataFrame(rows, SCHEMA), most).collect()]
    assert len(found) == len(set(found)) and set(found) == {r[:2] for r in rows} - bad
    assert bad or most == 1.0


def test_single_person_exchanges_no_pairs(spark):
    df, n = crowd(spark)
    assert exchanged(tracks.single_person(df, 0.97)) < 2 * (n + 4 * 150) + 6 * 150  # as above, the tracks once more, and those in the way


def test_vote_query_exchanges_no_pairs(spark, tmp_path):
    """150 users of one video over 40 days and one after them, as many votes as the SQL gives."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE events AS SELECT d * 151 + u AS event_id, TIMESTAMP '2024-01-01' + to_days((d + u // 150 * 40)::INT) AS ts, u * 10 AS user_id, 'view' AS event_type, (30 + (u + d) % 21)::DOUBLE AS value, '' AS props
      FROM range(151) a(u), range(40) b(d) WHERE d <> u AND (d < 3 * u OR d % 2 = 0)""")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    n = con.sql("SELECT count(*) FROM events").fetchall()[0][0]
    got, want = driver.queries()["q17_vote"](spark, str(tmp_path)), con.sql(driver.oracle_sql()["q17_vote"])
    rows = want.fetchall()
    assert sorted(tuple(r[c] for c in want.columns) for r in got.collect()) == sorted(rows) and {r[2] for r in rows} == {2, 3}
    assert exchanged(got) < 5 * n  # days of tracks for each of three voters, and on to their tracks
