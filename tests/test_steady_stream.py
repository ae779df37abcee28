"""Steady segments over a stream: any cut into micro-batches gives the batch result, after restarts too."""

import itertools
import random

import pytest

from strideframe.operators import segments
from strideframe.streaming import steady

PAIRS = "video string, pair_idx long, dx int, dy int, confidence double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def made(size):
    rng = random.Random(4)
    pairs, videos = [], []
    for v in range(14):
        n = rng.randint(2, 40)
        frames = (n + 1) * size - rng.randint(0, size - 1)
        videos.append((f"v{v}", frames, rng.choice([5.0, 10.0, 25.0])))
        odds = rng.choice([0.2, 0.5, 0.85])
        pairs += [(f"v{v}", k, 0 if rng.random() < odds else 9, 0, rng.choice([0.9, 0.9, 0.9, 0.1])) for k in range(n)]
    return pairs, [*videos, ("none", 3, 5.0), ("zero", 6 * size, 0.0)]


@pytest.mark.parametrize(("size", "seconds", "seed"), [(5, 1.5, 1), (5, 0.0, 2), (1, 0.0, 3)])
def test_any_micro_batches(spark, tmp_path, size, seconds, seed):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    pairs, videos = made(size)
    table = spark.createDataFrame(videos, "video string, frames_number long, fps double")
    want = segments.steady_segments(spark.createDataFrame(pairs, PAIRS), table, size, 2.0, 0.2, seconds)
    want = sorted((r["video"], r["start"], r["end"], r["seg_idx"]) for r in want.collect())
    assert len(want) > 8
    rng = random.Random(seed)
    sent = pairs + rng.sample(pairs, 40)  # some twice
    rng.shuffle(sent)
    cuts = sorted(rng.sample(range(len(sent)), 4))
    out = str(tmp_path / "out")
    for k, (low, high) in enumerate(itertools.pairwise([0, *cuts, len(sent)])):
        spark.createDataFrame(sent[low:high], PAIRS).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={k}"))
        if k in (1, 3, 4):  # each start goes on from the checkpoint, with one or two files
            stream = spark.readStream.schema(PAIRS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "batch=*"))
            query = steady.steady_segments(stream, table, size, 2.0, 0.2, seconds).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            query.awaitTermination(120)
    found = sorted((r["video"], r["start"], r["end"], r["seg_idx"]) for r in spark.read.parquet(out).collect())
    assert found == want


def test_a_video_that_stays_away_ends(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    table = spark.createDataFrame([("v", 100, 5.0)], "video string, frames_number long, fps double")
    folder = str(tmp_path / "in")
    spark.createDataFrame([("v", k, 0, 0, 0.9) for k in (0, 1, 2, 6, 7)], PAIRS).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(PAIRS).parquet(folder)
    query = steady.steady_segments(stream, table, 5, min_seconds=1.0, wait_ms=1).writeStream.format("memory").queryName("away").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    for _ in range(60):
        query.awaitTermination(1)
        if spark.table("away").count() == 2:
            break
    query.stop()
    assert sorted((r["start"], r["end"], r["seg_idx"]) for r in spark.table("away").collect()) == [(0, 19, 0), (30, 44, 1)]
