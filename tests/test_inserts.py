"""Keyed inserts: keys stay unique when batches overlap, and replays change nothing."""

from pathlib import Path

from strideframe.sources import sinks

SCHEMA = "id string, title string, n int"


def held(spark, path):
    return sorted((r["id"], r["title"], r["n"]) for r in sinks.inserted(spark, path).collect())


def test_batches_overlap_and_are_replayed(spark, tmp_path):
    path = str(tmp_path / "table")
    assert sinks.inserted(spark, path) is None
    first = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), ("b", "other", 3), (None, "z", 4)], SCHEMA)
    sinks.insert_batch(first, path, "id", "one", 0)
    once = held(spark, path)
    assert [r[0] for r in once] == ["a", "b"]
    second = spark.createDataFrame([("b", "late", 9), ("c", "w", 5), ("c", "w", 5)], SCHEMA)
    sinks.insert_batch(second, path, "id", "one", 1)
    sinks.insert_batch(spark.createDataFrame([("c", "elsewhere", 0), ("d", "v", 6)], SCHEMA), path, "id", "two", 0)
    whole = held(spark, path)
    assert whole == [*once, ("c", "w", 5), ("d", "v", 6)]
    for rows, writer, batch in ((first, "one", 0), (second, "one", 1), (first.limit(0), "three", 7)):
        sinks.insert_batch(rows, path, "id", writer, batch)
        assert held(spark, path) == whole
    assert {(r["writer"], r["batch"]) for r in sinks.inserted(spark, path).select("writer", "batch").collect()} == {("one", "0"), ("one", "1"), ("two", "0")}


def test_a_stream_that_repeats_its_last_batch(spark, tmp_path):
    path, checkpoint = str(tmp_path / "table"), tmp_path / "checkpoint"

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "batch=*"))
        sinks.insert_stream(stream, path, "id", "stream").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination(60)

    for k, rows in enumerate([[("a", "x", 1), ("b", "y", 2)], [("b", "later", 3), ("c", "z", 4)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"batch={k}"))
    run()
    before = held(spark, path)
    assert [r[0] for r in before] == ["a", "b", "c"]
    for name in ("commits/1", "commits/.1.crc"):  # as if the driver was lost after the write and before its commit
        Path(checkpoint / name).unlink(missing_ok=True)
    run()
    assert held(spark, path) == before
