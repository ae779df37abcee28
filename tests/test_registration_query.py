"""q42 registers every batch of every video, as a plain double loop does."""

import numpy as np
from pyspark.sql import functions as F

from strideframe.plans import sequences


def test_all_batches_are_registered(spark, tmp_path):
    sizes = {3: 58, 4: 12, 5: 4}
    events = [(100 * v + k, v, f"2024-01-01 00:{k:02d}:00", float(k)) for v, n in sizes.items() for k in range(n)]
    table = spark.createDataFrame(events, "event_id long, user_id long, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    table.write.parquet(str(tmp_path / "events.parquet"))
    x = np.arange(16)
    rows = spark.range(16 * 16 * 16).selectExpr("id", "pmod(hash(id % 16, id div 16 % 16, id div 256), 256) AS p").where("id < 6 * 256").orderBy("id").collect()
    base = {v: np.array([float(r["p"]) for r in rows if r["id"] // 256 == v]).reshape(16, 16) for v in sizes}
    window = np.sqrt(np.clip(np.outer(np.hamming(16), np.hamming(16)), 1e-6, 1))
    wave = np.exp(-2j * np.pi * np.outer(x, x) / 16)
    seen = lambda v, b: np.roll(wave @ (base[v][:, (x + 2 * b) % 16] * window) @ wave, (8, 8), (0, 1))
    want = {}
    for v, n in sizes.items():
        for k in range(-(-n // 5) - 1):
            one = seen(v, k) * np.conj(seen(v, k + 1))
            plane = (wave.conj() @ (one / np.abs(one)) @ wave.conj() / 256).real
            row, column = np.unravel_index(plane.argmax(), plane.shape)
            want[v, k] = *(int(i if i <= 8 else 15 - i) for i in (column, row)), round(float(plane[row, column]), 5)
    found = {(r["video"], r["pair_idx"]): (r["dx"], r["dy"], r["confidence"]) for r in sequences.q42_registration(spark, str(tmp_path)).collect()}
    assert len(want) == 11 + 2 and found.keys() == want.keys()
    assert all(found[k][:2] == want[k][:2] and abs(found[k][2] - want[k][2]) < 2e-5 for k in want)
