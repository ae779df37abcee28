"""Readers (S-04..S-07, S-09..S-11, S-18, D22)."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType
from pyspark.sql.window import Window as W

from ..functions import text


def list_files(spark: SparkSession, folder: str, extensions: Sequence[str] = (), recursive: bool = False) -> DataFrame:
    """S-05, S-06, P-07: path, name, stem, extension, size and dataset of files; no contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path", F.col("length").alias("size"))
    name = text.file_name(F.col("path"))
    out = files.select("path", name.alias("name"), text.stem(name).alias("stem"), text.extension(name).alias("extension"), "size", text.dataset_of(F.regexp_replace("path", r"^[a-z]+:/*", "")).alias("dataset"))
    return out.where(F.col("extension").isin(list(extensions))) if extensions else out


def url_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """S-04, F-05, F-07, P-08: channel_id, url, video_id, ordinal of exported sheets (CSV with a header, the url in column 1)."""
    raw = spark.read.option("header", "true").csv(folder)
    url = F.col(f"`{raw.columns[1]}`")
    stem = text.stem(text.file_name(F.col("_metadata.file_path")))
    rows = raw.select(text.channel_id(stem).alias("channel_id"), url.alias("url"), F.monotonically_increasing_id().alias("ordinal"))
    return rows.where(text.valid_url(F.col("url"))).withColumn("video_id", text.id_from_url(F.col("url")))


def class_table(spark: SparkSession, path: str) -> DataFrame:
    """S-07, D21: a CSV with a label column; further columns pass through."""
    return spark.read.option("header", "true").csv(path)


def json_documents(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """S-09."""
    reader = spark.read.option("multiLine", "true")
    return (reader.schema(schema) if schema else reader).json(path)


def read_yaml(document: str) -> dict:
    """S-11, D23: a configuration; a document that cannot be parsed is a ValueError."""
    try:
        return yaml.safe_load(document) or {}
    except yaml.YAMLError as error:
        raise ValueError(str(error)) from error


def read_arrays(spark: SparkSession, folder: str, pattern: str = "*.npy", by: Sequence[str] = ()) -> DataFrame:
    """S-10: path, shape and flat values of .npy files, one at a time; objects are never unpickled.

    Files of sinks.write_arrays have the pattern "part-*"; by names the columns
    that its folders carry. Batches of files that go to Python are bounded by
    spark.sql.execution.arrow.maxBytesPerBatch.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", *by, "content")

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, content in enumerate(batch.pop("content")):
                one = np.load(io.BytesIO(content), allow_pickle=False)
                yield batch.iloc[[k]].assign(shape=[list(one.shape)], values=[one.astype(np.float64).reshape(-1)])

    shape = StructType(files.schema.fields[:-1]).add("shape", ArrayType(LongType())).add("values", ArrayType(DoubleType()))
    return files.mapInPandas(load, shape)


def array_rows(arrays: DataFrame) -> DataFrame:
    """path, frame and joints of arrays whose first dimension is the frame."""
    width = F.expr("cast(aggregate(slice(shape, 2, size(shape)), 1L, (a, x) -> a * x) as int)")
    frames = arrays.select("path", "values", width.alias("w"), F.explode(F.expr("sequence(0L, shape[0] - 1)")).alias("frame"))
    return frames.select("path", "frame", F.expr("slice(values, cast(frame * w + 1 as int), w)").alias("joints"))


def annotations(lines: DataFrame, value: str = "value", order: str = "ordinal", document: str | None = None) -> DataFrame:
    """S-18, D22: url, start_time, end_time, label of lines: a url, then "HH:MM:SS - HH:MM:SS = label".

    Inverted and empty ranges are left out, exact repeats count once. Lines
    need an ordinal; a document (all lines, where none is named) is one group, as its order
    matters, and a url counts for its own document alone.
    """
    line = F.trim(value)
    urls = lines.withColumn("url", F.last(F.when(line.rlike("^https?://"), line), ignorenulls=True).over(W.partitionBy(*[document] if document else []).orderBy(order)))
    pattern = r"^(\d+):(\d+):(\d+)\s*-\s*(\d+):(\d+):(\d+)\s*=\s*(.*)$"
    part = lambda k: F.regexp_extract(line, pattern, k).cast("double")
    rows = urls.where(line.rlike(pattern)).select("url", (part(1) * 3600 + part(2) * 60 + part(3)).alias("start_time"), (part(4) * 3600 + part(5) * 60 + part(6)).alias("end_time"), F.trim(F.regexp_extract(line, pattern, 7)).alias("label"))
    return rows.where("end_time > start_time").distinct()


def prompt_of(document: str) -> dict:
    """S-09 for a single prompt."""
    return json.loads(document)
