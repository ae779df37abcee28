"""Streaming forms give what their batch forms give, but for rows that come too late."""

import datetime as dt

from strideframe import streaming

T0 = dt.datetime(2024, 1, 1)


def run(spark, tmp_path, rows, build, name):
    """Each list of rows is one file and one micro-batch."""
    schema = "video string, ts timestamp, value double"
    for k, some in enumerate(rows):
        spark.createDataFrame([(v, T0 + dt.timedelta(seconds=s), x) for v, s, x in some], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"batch={k}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "batch=*"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    seconds = lambda t: int((t - T0).total_seconds())
    return {(r["video"], seconds(r["start"]), seconds(r["end"])): r for r in spark.table(name).collect()}


def test_windowed_means(spark, tmp_path):
    rows = [[("a", 5, 1.0), ("a", 50, 3.0), ("b", 10, 7.0)], [("a", 1000, 9.0)], [("a", 1100, 9.0)], [("a", 7, 100.0), ("a", 2000, 9.0)], [("a", 4000, 1.0)]]
    found = run(spark, tmp_path, rows, lambda s: streaming.windowed_means(s, "ts", "value"), "means")
    assert (found["a", 0, 60]["mean_value"], found["a", 0, 60]["n_frames"]) == (2.0, 2) and found["b", 0, 60]["n_frames"] == 1
    assert found["a", 960, 1020]["mean_value"] == 9.0


def test_session_segments(spark, tmp_path):
    rows = [[("a", 0, 1.0), ("a", 3, 1.0), ("a", 7, 1.0), ("a", 20, 1.0)], [("a", 500, 1.0)], [("a", 1000, 1.0)], [("a", 2000, 1.0)]]
    found = run(spark, tmp_path, rows, lambda s: streaming.session_segments(s, "ts"), "sessions")
    assert found["a", 0, 12]["n_frames"] == 3 and found["a", 20, 25]["n_frames"] == 1
