"""Token ids in patched frame-of-reference files (operator 6).

Ids are stored in blocks of BLOCK. A block subtracts its minimum and packs the
differences at the smallest width that holds at least PERCENT percent of them;
the others keep their low bits in place and put their high bits on an
exception list (position, high bits). The start of every block is indexed, so
any document can be read without decoding what lies before it.

One file holds consecutive documents in ascending doc_id order. Files follow
each other by (part, number), which each carries, as Spark's writer names them:

    magic "PFR3", documents, documents without an id (they come first), ids, blocks,
        part, number                           little-endian unsigned 32 bits each
    ids in earlier files of the part           unsigned 64 bits
    block starts                               unsigned 32 bits, from the payload's start
    lengths of the documents                   unsigned 32 bits
    doc_ids (0 where there is none)            signed 64 bits
    payload, per block: minimum (4 bytes), width, exceptions (1 byte each),
        packed differences (BLOCK * width / 8 bytes),
        exception positions (1 byte each), their high bits (4 bytes each)
    a line feed                                from Spark's writer of text files
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..sources import sinks
from . import tokens
from .common import WorkTables, gathered, releasing

BLOCK, PERCENT = 128, 90
MAGIC, HEADER = b"PFR3", 36
#: Id that ends each document, and ids after which a file is closed.
END, FILE_IDS = 2, 1 << 20
#: Text bytes that are encoded at a time.
CHUNK = 6 << 20


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[k], starts[k] + 1, ... sizes[k] of them, for every k in turn."""
    upto = np.cumsum(sizes)
    return np.repeat(starts - (upto - sizes), sizes) + np.arange(upto[-1] if len(upto) else 0)


def encode_blocks(ids: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, bytes]:
    """Block starts and payload of unsigned 32-bit ids; the last block is filled with its last id."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint32), b""
    count = -(-n // BLOCK)
    table = np.concatenate([ids, np.full(count * BLOCK - n, ids[-1], ids.dtype)]).astype("<u4").reshape(count, BLOCK)
    low = table.min(axis=1)
    diff = table - low[:, None]
    rank = (BLOCK * percent + 99) // 100 - 1
    width = np.frexp(np.sort(diff, axis=1)[:, rank].astype(np.float64))[1].astype(np.int64)
    # two shifts, as one of 32 bits is not defined
    high = (diff >> (width // 2).astype(np.uint32)[:, None]) >> (width - width // 2).astype(np.uint32)[:, None]
    listed_at = np.flatnonzero(high)
    block, where = listed_at // BLOCK, listed_at % BLOCK
    many = np.bincount(block, minlength=count)
    sizes = 6 + BLOCK // 8 * width + 5 * many
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    out[starts[:, None] + np.arange(4)] = low[:, None].view(np.uint8)
    out[starts + 4], out[starts + 5] = width, many
    for w in np.unique(width[width > 0]):
        at = np.flatnonzero(width == w)
        room = "<u2" if w <= 16 else "<u4"
        bits = np.unpackbits(diff[at].astype(room).view(np.uint8).reshape(len(at), BLOCK, -1), axis=2, bitorder="little", count=int(w))
        out[(starts[at] + 6)[:, None] + np.arange(BLOCK // 8 * w)] = np.packbits(bits.reshape(len(at), -1), axis=1, bitorder="little")
    listed = starts + 6 + BLOCK // 8 * width
    out[_spread(listed, many)] = where
    out[_spread(listed + many, 4 * many)] = high.reshape(-1)[listed_at].view(np.uint8)
    return starts.astype(np.uint32), out.tobytes()


def decode_blocks(payload: bytes, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of blocks first..last-1."""
    raw = np.frombuffer(payload, np.uint8)
    at = starts[first:last].astype(np.int64)
    out = np.zeros((len(at), BLOCK), "<u4")
    low = raw[at[:, None] + np.arange(4)].copy().view("<u4").reshape(-1)
    width, many = raw[at + 4].astype(np.int64), raw[at + 5].astype(np.int64)
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        bits = np.unpackbits(raw[at[rows][:, None] + 6 + np.arange(BLOCK // 8 * w)], axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
        room = 16 if w <= 16 else 32
        wide = np.zeros((len(rows), BLOCK, room), np.uint8)
        wide[:, :, :w] = bits
        out[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u2" if room == 16 else "<u4").reshape(len(rows), BLOCK)
    listed = at + 6 + BLOCK // 8 * width
    block = np.repeat(np.arange(len(at)), many)
    high = raw[_spread(listed + many, 4 * many)].copy().view("<u4").astype(np.uint64)
    out[block, raw[_spread(listed, many)].astype(np.int64)] |= (high << width[block].astype(np.uint64)).astype("<u4")
    return (out + low[:, None]).reshape(-1)


def encode_file(documents: list[np.ndarray], doc_ids: list[int | None] | None = None) -> bytes:
    """The file of some documents' ids, in their order; documents without an id come first."""
    ids = np.concatenate(documents) if documents else np.zeros(0, np.uint32)
    return _file(np.asarray([len(d) for d in documents], np.int64), ids, [None] * len(documents) if doc_ids is None else doc_ids)


def _file(lengths: np.ndarray, ids: np.ndarray, doc_ids: list[int | None], part: int = 0, number: int = 0, before: int = 0) -> bytes:
    starts, payload = encode_blocks(ids)
    head = np.asarray([len(lengths), sum(x is None for x in doc_ids), len(ids), len(starts), part, number], "<u4").tobytes() + before.to_bytes(8, "little")
    names = np.asarray([x or 0 for x in doc_ids], "<i8").tobytes()
    return MAGIC + head + starts.astype("<u4").tobytes() + lengths.astype("<u4").tobytes() + names + payload


class TokenFile:
    """Reads a file; `document(k)` decodes only the blocks that document k touches."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token file")
        n, nulls, self.ids, blocks, self.part, self.number = np.frombuffer(data, "<u4", 6, 4).tolist()
        self.before = int.from_bytes(data[HEADER - 8 : HEADER], "little")
        self.starts = np.frombuffer(data, "<u4", blocks, HEADER)
        self.lengths = np.frombuffer(data, "<u4", n, HEADER + 4 * blocks).astype(np.int64)
        self.doc_ids = [None] * nulls + np.frombuffer(data, "<i8", n, HEADER + 4 * (blocks + n))[nulls:].tolist()
        self.payload = data[HEADER + 4 * (blocks + n) + 8 * n :]
        self.ends = np.cumsum(self.lengths)

    def document(self, k: int) -> np.ndarray:
        end = int(self.ends[k])
        start = end - int(self.lengths[k])
        first = start // BLOCK
        return decode_blocks(self.payload, self.starts, first, -(-end // BLOCK))[start - first * BLOCK : end - first * BLOCK]

    def all(self) -> np.ndarray:
        return decode_blocks(self.payload, self.starts, 0, len(self.starts))[: self.ids]


def _encode(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.tokenizer(path), TaskContext.get().partitionId()
        docs: list[int | None] = []
        lengths, held = [], []
        number, before, size = 0, 0, 0

        def close():
            file = _file(np.concatenate(lengths), np.concatenate(held), docs, part, number, before)
            return pa.RecordBatch.from_arrays([pa.array([file], pa.binary())], names=["content"])

        for batch in gathered(batches, limit=CHUNK):
            found, counts = encoder.encode(batch.column(batch.schema.get_field_index("text")), end)
            ids, ends, low = batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), np.cumsum(counts), 0
            while low < len(ids):  # as many documents as the file still takes, one at least
                done = int(ends[low - 1]) if low else 0
                high = max(int(np.searchsorted(ends, done + FILE_IDS - size, side="right")), low + (not size))
                docs += ids[low:high]
                lengths.append(counts[low:high])
                held.append(found[done : int(ends[high - 1])] if high > low else found[:0])
                size += len(held[-1])
                if high < len(ids):
                    yield close()
                    number, before, size, docs, lengths, held = number + 1, before + size, 0, [], [], []
                low = high
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end: int = END) -> None:
    """Writes the files of docs into a folder of any store that Spark writes to, in one commit.

    Documents are dealt by ranges of doc_id and sorted, so
    (part, number) order is ascending doc_id order; null ids come first. Rows
    that share a doc_id are spread by a salt.
    """
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    salted = lean.withColumn("__salt", F.pmod(F.monotonically_increasing_id() * 48271, F.lit(65521)))
    dealt = salted.repartitionByRange("doc_id", "__salt").sortWithinPartitions("doc_id", "__salt").select("doc_id", "text")
    sinks.write_files(dealt.mapInArrow(releasing(_encode(tokenizer_path, end)), "content binary"), folder)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            file = TokenFile(content.as_py())
            raw, ends = memoryview(file.all()).cast("B"), file.ends
            starts = ends - file.lengths
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(file.doc_ids, pa.int64()), pa.array(np.full(len(crcs), file.part, np.int32)), pa.array(starts + file.before), pa.array(file.lengths), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "local", "n_tokens", "ids_crc32"],
            )


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a folder's files: doc_id, part, local (ids before it in the part), n_tokens, ids_crc32."""
    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(releasing(_decode), "doc_id long, part int, local long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, tokenizer_path: str, end: int = END) -> DataFrame:
    """One row per document, read back from the files: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts hold the end id alone. Null doc_ids come first.
    Repeated doc_ids follow each other in a fixed but arbitrary order. A text of
    more than FILE_IDS ids has a file of its own. Other columns of docs are not
    read. An empty table gives no rows.
    """
    tables = WorkTables(docs.sparkSession, "tokens")
    folder = f"{tables.root}/token_files"
    write_token_files(docs, tokenizer_path, folder, end)
    read = tables.save(read_token_files(docs.sparkSession, folder), "read")
    sums = read.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each task that wrote
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("part", before.alias("before"))
    return read.join(starts, "part").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
