"""Shared pieces: work tables on shared storage, word splitting, batches."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than U+0020 and U+0009..U+000D.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows of an Arrow batch.
BATCH = 2000


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor reads.

    Where it is unset a local session takes a folder under /tmp; a cluster
    session is refused, as its executors share no local disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:///tmp/checkpoints"
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows at most in this session: rows hold whole documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH:
        spark.conf.set(name, str(BATCH))


class WorkTables:
    """Parquet tables that cut lineage; each is written once and read back.

    A written table survives lost executors. Tables in `scratch` can be
    dropped once nothing that will still run reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        bound_batches(spark)
        self.spark = spark
        self.root = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame, what: str = "t", batch: int | None = None, by: str | None = None) -> DataFrame:
        """batch: rows of an Arrow batch while this table is made, where rows are very wide. by: a column of few values that readers select on."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{what}"
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        usual = self.spark.conf.get(name)
        if batch:
            self.spark.conf.set(name, str(batch))
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path, partitionBy=by)
        finally:
            self.spark.conf.set(name, usual)
        table = self.spark.read.schema(df.schema).parquet(path)
        table.work_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.work_path)
            path.getFileSystem(conf).delete(path, True)


def sealed(docs: DataFrame, needed: Sequence[str], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """run over docs whose other columns have neutral names meanwhile, so that no name can clash; run keeps the columns."""
    inner = [c if c in needed else f"column_{k}" for k, c in enumerate(docs.columns)]
    return run(docs.toDF(*inner)).select(*inner).toDF(*docs.columns)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null. Runs in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def split_words(raw: bytes | None) -> list[bytes]:
    """Words of UTF-8 bytes; bytes.split() cuts at exactly the six ASCII spaces."""
    return raw.split() if raw else []


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches of about `limit` text bytes, one row at least, so that memory per step is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = text_bytes(batch, text)
        step = (np.cumsum(lengths) - lengths) // limit
        cuts = np.flatnonzero(np.diff(step)) + 1
        for low, high in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(low, high - low)


def text_bytes(batch: pa.RecordBatch, text: str = "text") -> np.ndarray:
    """Bytes of each row's text; 0 for null."""
    return pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def gathered(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches joined or sliced to about `limit` text bytes, one row at least."""
    held, size = [], 0
    for batch in pieces(batches, text, limit):
        n = int(text_bytes(batch, text).sum())
        if held and size + n > limit:
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += n
    if held:
        yield pa.concat_batches(held)


def per_worker(kind: str, key, make):
    """What make() returned when this Python worker first asked for `key` of this kind.

    Functions reach workers by value, with globals of their own for each task;
    a module that lives in the worker keeps caches between tasks. Caches of
    other kinds go, as the stages that used them have ended.
    """
    module = sys.modules.setdefault("strideframe_worker", types.ModuleType("strideframe_worker"))
    if getattr(module, "kind", None) != kind:
        module.kind, module.kept = kind, {}
    if key not in module.kept:
        module.kept[key] = make()
    return module.kept[key]


def releasing(run):
    """run, and then freed memory goes back to the system, since Python workers stay on while other stages need it."""

    def whole(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def word_hashes() -> WordHashes:
    return per_worker("word hashes", None, WordHashes)


class WordHashes(dict):
    """Word to 64-bit hash; a bounded cache in front of xxh3."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def odd_constants(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers from a seed."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def windows_hash(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all n-word windows of one text, by a multilinear sum and a finaliser."""
    if len(hashes) < n:
        return np.empty(0, dtype=np.uint64)
    last = len(hashes) - n + 1
    total = np.zeros(last, dtype=np.uint64)
    for k, factor in enumerate(odd_constants(seed, n)):
        total += mix64(hashes[k : k + last]) * factor if n > 1 else hashes[k : k + last] * factor
    return mix64(total)


#: Slots of 64 bits of a filter of hashes: 8 MB at most, whatever the data.
FILTER_SLOTS = 1 << 20


def _filter_bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_SLOTS * 64 - 1)
    return hashes & mask, (hashes >> np.uint64(32)) & mask


def _filter_slots(batches):
    for batch in batches:
        bits = np.concatenate(_filter_bits(batch.column(0).to_numpy().view(np.uint64)))
        slots, place = np.unique(bits >> np.uint64(6), return_inverse=True)
        marks = np.zeros(len(slots), np.uint64)
        np.bitwise_or.at(marks, place, np.uint64(1) << (bits & np.uint64(63)))
        yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(marks.view(np.int64))], names=["slot", "bits"])


def hash_filter(hashes: DataFrame) -> np.ndarray:
    """A filter of fixed size that holds a column of well mixed hashes (long, not null), two bits each.

    It passes all that it holds and, as it fills up, ever more of what it
    doesn't: it spares exchanges, and something exact must follow.
    """
    slots = hashes.mapInArrow(_filter_slots, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(FILTER_SLOTS, np.uint64)
    filled[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return filled


def in_filter(filled: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    one, two = _filter_bits(hashes)
    found = (filled[one >> np.uint64(6)] >> (one & np.uint64(63)) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(found)
    two = two[at]
    found[at] = (filled[two >> np.uint64(6)] >> (two & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found
