"""Sharding by a Feistel permutation over global row numbers (operator 8).

Rows are numbered in the order of (doc_id, text checksum, size). A keyed
Feistel network over the next power of four permutes the numbers; values
beyond the last row are walked along their cycle until they fall inside. The
permuted number p gives shard p mod S and slot p div S, so counts differ by
one at most and both can be computed from a row number alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WorkTables, mix64

SHARDS = 16
ROUNDS = 6


def feistel(numbers: np.ndarray, n: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """The permuted place, below n, of each row number below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    shift = np.uint64(half)
    keys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    out = np.asarray(numbers, dtype=np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & low
        for key in keys:
            left, right = right, left ^ (mix64(right + key) & low)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def numbered(rows: DataFrame, order: list[str], tables: WorkTables) -> DataFrame:
    """rows with __row, a gapless number from 0 in the given order.

    One range exchange; a partition numbers its own rows and adds the count of
    all partitions before it. Rows that agree in every order column are spread
    by a further salt, as a third of the table may be copies of one row.
    """
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id() * 48271, F.lit(65521)))
    keys = [*order, "__salt"]
    # partition in the upper bits, place within it in the lower 33
    placed = salted.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__salt").withColumn("__id", F.monotonically_increasing_id())
    table = tables.save(placed, "numbered").withColumns({"__part": F.shiftright("__id", 33), "__local": F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = table.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__part", before.alias("__before"))
    return table.join(starts, "__part").withColumn("__row", F.col("__before") + F.col("__local")).drop("__id", "__part", "__local", "__before")


def placed(rows: DataFrame, total: int, shards: int, seed: int) -> DataFrame:
    """rows with shard and slot in place of __row; only row numbers pass through Python."""

    @F.pandas_udf("long")
    def permuted(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), total, seed))

    found = rows.withColumn("__place", permuted("__row"))
    return found.withColumns({"shard": (F.col("__place") % shards).cast("int"), "slot": F.floor(F.col("__place") / shards).cast("long")}).drop("__row", "__place")


def shard_digest(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: counts of shards differ by one at most, slots are
    gapless from 0. Null text has size 1 and the checksum of no bytes. Null
    doc_ids sort first. Rows equal in doc_id and text are interchangeable. Texts
    of any length count whole. Other columns of docs are not read. An empty
    table gives no rows.
    """
    tables = WorkTables(docs.sparkSession, "shards")
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = numbered(lean, ["doc_id", "text_crc32", "size"], tables)
    out = placed(rows, rows.count(), shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """docs with shard and slot, ready for write.partitionBy("shard").

    Placed as in shard_digest; docs keeps all its columns, a clashing shard or
    slot column is replaced. Texts pass one exchange and no Python.
    """
    docs = docs.drop("shard", "slot")
    inner = [c if c in ("doc_id", "text") else f"column_{k}" for k, c in enumerate(docs.columns)]
    raw = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    keyed = docs.toDF(*inner).withColumns({"__key": F.col("doc_id").cast("long"), "__crc": F.crc32(raw), "__size": F.octet_length(raw)})
    rows = numbered(keyed, ["__key", "__crc", "__size"], WorkTables(docs.sparkSession, "shards"))
    return placed(rows, rows.count(), shards, seed).select(*inner, "shard", "slot").toDF(*docs.columns, "shard", "slot")
