"""Work on files one by one, with resume (X-07, X-09).

A file's outcome (rows, or the error that ended it) is one row of a table, and
that table is the list of what is done: a rerun takes the files that aren't in
it, those that have changed since, and those that failed.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

KEYS = ("path", "modificationTime")


def outcomes(spark: SparkSession, out: str) -> DataFrame | None:
    """path, modificationTime, rows, error, seconds, wave of all tries under out; None before the first."""
    try:
        return spark.read.parquet(out)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def finished(spark: SparkSession, out: str) -> DataFrame | None:
    """The latest good outcome of each file, a row for each of its rows: path and the columns that the work gives."""
    tries = outcomes(spark, out)
    if tries is None:
        return None
    latest = tries.where("error is null").groupBy("path").agg(F.max_by("rows", "modificationTime").alias("rows"))
    return latest.select("path", F.inline("rows"))


def failed(spark: SparkSession, out: str) -> DataFrame | None:
    """path and error of files that have no good outcome for their latest state."""
    tries = outcomes(spark, out)
    if tries is None:
        return None
    rank = F.struct("modificationTime", F.col("error").isNull(), "error")
    return tries.groupBy("path").agg(F.max(rank).alias("x")).select("path", F.col("x.error").alias("error")).where("error is not null")


def process_files(spark: SparkSession, folder: str, pattern: str, work: Callable[[str, bytes], Iterable[tuple]], schema: str, out: str, waves: int = 1) -> int:
    """X-07, X-09: work(path, content) of each file that is not done yet; returns how many files were taken.

    work gives a file's rows as tuples of schema. Whatever it raises becomes the
    error of that file, and the others go on; rows it gave before are left out.
    Files are dealt to waves by a hash of their path, and each wave is committed
    before the next one starts, so a lost driver costs one wave at most. One
    file's content and rows are held at a time. Spark's reader passes over empty files.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, changed, content in batch[[*KEYS, "content"]].itertuples(index=False):
                started, rows, error = time.monotonic(), [], None
                try:
                    rows = [dict(zip(names, row, strict=True)) for row in work(path, content)]
                except Exception as reason:  # whatever a file does to its worker is that file's outcome
                    error = f"{type(reason).__name__}: {reason}"
                yield pd.DataFrame({"path": [path], "modificationTime": [changed], "rows": [rows], "error": [error], "seconds": [time.monotonic() - started]})

    taken = 0
    for wave in range(waves):
        tries = outcomes(spark, out)
        left = files.where(F.pmod(F.xxhash64("path"), F.lit(waves)) == wave)
        if tries is not None:
            left = left.join(tries.where("error is null").select(*KEYS), list(KEYS), "left_anti")
        done = left.mapInPandas(run, f"path string, modificationTime timestamp, rows array<struct<{schema}>>, error string, seconds double")
        before = 0 if tries is None else tries.count()
        done.withColumn("wave", F.lit(wave)).write.mode("append").parquet(out)
        taken += outcomes(spark, out).count() - before
    return taken
