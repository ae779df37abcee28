"""Writers (S-21, S-22, S-26, S-27, S-34, S-35, S-37, X-20)."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.window import Window as W


def append(rows: DataFrame, path: str) -> None:
    """S-21, S-22: in one commit, after the checks of ingestion."""
    rows.write.mode("append").parquet(path)


def inserted(spark: SparkSession, path: str) -> DataFrame | None:
    """What insert_batch has written under path, with writer and batch; None before the first batch."""
    try:
        return spark.read.parquet(path).withColumns({x: F.col(x).cast("string") for x in ("writer", "batch")})
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def insert_batch(rows: DataFrame, path: str, key: str, writer: str, batch: int | str) -> None:
    """S-21, S-22: rows whose key isn't there yet, as one batch of a writer; the table's keys stay unique.

    Each batch is a folder of its own, and a batch that is written again takes
    the place of its first try, so a replay changes nothing. Of rows with one
    key the one with the smallest hash stays, on each try the same; null keys
    are left out. Only one batch is written at a time. Rows have no columns
    named writer or batch.
    """
    order = W.partitionBy(key).orderBy(F.xxhash64(*rows.columns))
    once = rows.where(F.col(key).isNotNull()).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    before = inserted(rows.sparkSession, path)
    if before is not None:
        others = before.where((F.col("writer") != writer) | (F.col("batch") != str(batch)))
        once = once.join(others.select(key), key, "left_anti")
    once.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={batch}")


def insert_stream(rows: DataFrame, path: str, key: str, writer: str) -> DataStreamWriter:
    """insert_batch of each micro-batch of a stream, under its number; start it with a checkpoint of its own for each writer."""
    return rows.writeStream.foreachBatch(lambda some, number: insert_batch(some, path, key, writer, number))


def write_segments(segments: DataFrame, path: str, filter_name: str) -> None:
    """S-27, X-20: one partition for each filter; segments of a video stay together in a file."""
    segments.withColumn("filter_name", F.lit(filter_name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("filter_name").parquet(path)


def write_by_class(rows: DataFrame, path: str, label: str = "label") -> None:
    """S-34: one folder of CSV files for each class."""
    rows.write.mode("overwrite").option("header", "true").partitionBy(label).csv(path)


def write_buckets(rows: DataFrame, path: str, bucket: str = "bucket") -> None:
    """S-33: one folder for each bucket."""
    rows.write.mode("overwrite").partitionBy(bucket).parquet(path)


def write_files(rows: DataFrame, path: str, content: str = "content", by: Sequence[str] = ()) -> None:
    """S-35: the bytes of each row as a file of its own, a line feed after them, in a folder for each value of by.

    Spark's text writer carries the bytes as they are, to any store that it
    reaches: a task's files show when it commits, and those of a failed try
    never do. Null bytes make a file of the line feed alone.
    """
    named = rows.select(*by, F.col(content).cast("string").alias("content"))
    named.write.mode("overwrite").partitionBy(*by).option("maxRecordsPerFile", 1).text(path, compression="none", lineSep="\n")


def write_arrays(arrays: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """S-26, S-35: an .npy file for each row of shape and values (read_arrays gives such rows), in folders by columns.

    A line feed follows the array's data, which readers of the format don't
    look at. A shape that doesn't fit the values fails the write, and nothing
    is left of it.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index
            for k in range(batch.num_rows):
                values = np.asarray(batch.column(at("values"))[k].values, np.float64)
                held = io.BytesIO()
                np.save(held, values.reshape(batch.column(at("shape"))[k].as_py()), allow_pickle=False)
                yield pa.RecordBatch.from_arrays([*(batch.column(at(c)).slice(k, 1) for c in by), pa.array([held.getvalue()], pa.binary())], names=[*by, "content"])

    lean = arrays.select(*by, F.col("shape").cast("array<long>").alias("shape"), F.col("values").cast("array<double>").alias("values"))
    schema = lean.select(*by, F.lit(b"").alias("content")).schema
    write_files(lean.mapInArrow(save, schema), path, by=by)


def write_stage(rows: DataFrame, path: str) -> None:
    """S-26, S-35: as a table."""
    rows.write.mode("overwrite").parquet(path)


def write_documents(rows: DataFrame, path: str) -> None:
    """S-37."""
    rows.write.mode("overwrite").json(path)
