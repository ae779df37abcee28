"""Packing documents into fixed sequences by column generation (operator 2).

A document of up to CAPACITY ids stays whole; a longer one is cut into full
sequences and one tail. So there are CAPACITY distinct piece lengths at most,
whatever the corpus. Over the histogram of lengths a linear program chooses
how many sequences follow each pattern (so many pieces of each length in a
sequence). The first patterns are those of a fractional largest-first fill.
Further ones are generated: a knapsack by dynamic programming over the
program's dual prices finds the best new pattern, until further ones can save
no more than half a sequence, or GAP of all (by the bound that prices give). Counts are rounded down; the pieces left over (less than
one sequence of each pattern) are placed largest first. Documents' pieces are
ranked within their length, and a rank decides pattern, sequence and offset by
arithmetic.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import tokens
from .common import WorkTables, gathered, releasing

CAPACITY = 2048
#: Id that ends each document.
END = 1
#: Share of sequences that further patterns may still save when the program counts as solved.
GAP = 1e-4
#: Pricing rounds at most; stopping early costs padding and nothing else.
PRICINGS = 2000
#: Text bytes that are encoded at a time.
CHUNK = 4 << 20


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of `length` ids."""
    return [(k, min(capacity, length - k)) for k in range(0, length, capacity)]


def best_pattern(prices: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the pieces of most total price that fit in capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(lengths)
    sized, priced = lengths[order], prices[order]
    # a piece that costs no less room and earns no more than another is of no use
    useful = priced > np.maximum.accumulate(np.concatenate([[0], priced[:-1]]))
    order, sized, priced = order[useful], sized[useful], priced[useful]
    fits = np.searchsorted(sized, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        n = fits[c]
        best[c] = best[c - 1]
        if n:
            tried = best[c - sized[:n]] + priced[:n]
            k = int(tried.argmax())
            if tried[k] > best[c] + 1e-12:
                best[c], last[c] = tried[k], order[k]
    pattern, c = np.zeros(len(lengths), dtype=np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= lengths[last[c]]
    return float(best[capacity]), pattern


def largest_first(lengths: np.ndarray, left: np.ndarray, capacity: int, whole: bool) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(times, pattern, lengths used up) triples that use up `left`, each pattern filled with the largest piece that fits, again and again.

    whole: patterns hold no more than is left and are used a whole number of
    times; otherwise each is used until one of its lengths is used up.
    """
    out, left = [], left.copy()
    alive = np.flatnonzero(left)
    alive = alive[np.argsort(lengths[alive])]
    while len(alive):
        pattern, room, end = np.zeros(len(lengths), np.int64), capacity, len(alive)
        sized = lengths[alive]
        while room and end:
            end = int(np.searchsorted(sized[:end], room, side="right"))
            if not end:
                break
            k = alive[end - 1]
            n = int(room // lengths[k])
            if whole:
                n = min(n, int(left[k]))
            pattern[k], room, end = n, room - n * lengths[k], end - 1
        used = np.flatnonzero(pattern)
        ratio = left[used] // pattern[used] if whole else left[used] / pattern[used]
        times = ratio.min()
        left[used] -= times * pattern[used]
        gone = used[left[used] == 0] if whole else used[ratio <= times * (1 + 1e-9)]
        left[gone] = 0
        out.append((times, pattern, gone))
        alive = alive[left[alive] > 0]
    return out


def _first_basis(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """As many independent patterns as lengths, how often each is used, and the inverse of their matrix.

    A pattern holds the length that it uses up, and else lengths that later
    ones use up; so the matrix is triangular and its inverse comes row by row.
    """
    m = len(lengths)
    columns, rows, level = [], [], []
    for times, pattern, gone in largest_first(lengths, demand.astype(np.float64), capacity, whole=False):
        # lengths that are used up at once: all but one get a pattern of their own, which is not used yet
        columns += [pattern, *[np.where(np.arange(m) == k, capacity // lengths[k], 0) for k in gone[1:]]]
        rows += gone.tolist()
        level += [times] + [0.0] * (len(gone) - 1)
    inverse = np.zeros((m, m))
    table = np.stack(columns, axis=1)
    for place, row in enumerate(rows):
        inverse[place, row] = 1.0
        for k in np.flatnonzero(table[row, :place]):
            inverse[place] -= table[row, k] * inverse[k]
        inverse[place] /= table[row, place]
    return columns, np.asarray(level), inverse


def plan_patterns(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, np.ndarray]]:
    """(sequences, pieces of each length) pairs that place every piece exactly once.

    A revised simplex method; numpy's threaded routines are left out, as they
    may wait for ever in a process that has forked.
    """
    m, left = len(lengths), demand.astype(np.int64).copy()
    plan: list[tuple[int, np.ndarray]] = []
    if m:
        columns, level, inverse = _first_basis(lengths, demand, capacity)
        bound = float((lengths * demand).sum()) / capacity
        for _ in range(PRICINGS):
            spare = max(0.5, GAP * level.sum())
            if level.sum() <= bound + spare:
                break
            value, pattern = best_pattern(inverse.sum(axis=0), lengths, capacity)
            bound = max(bound, level.sum() / value)
            if value <= 1 + 1e-9 or level.sum() <= bound + spare:
                break
            used = np.flatnonzero(pattern)
            step = (inverse[:, used] * pattern[used]).sum(axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.where(step > 1e-9, np.maximum(level, 0) / step, np.inf)
            leaves = int(ratio.argmin())
            level -= ratio[leaves] * step
            level[leaves] = ratio[leaves]
            columns[leaves] = pattern
            row = inverse[leaves] / step[leaves]
            step[leaves] = 0
            inverse -= np.multiply.outer(step, row)
            inverse[leaves] = row
        for column, x in zip(columns, np.floor(level + 1e-7).astype(np.int64), strict=True):
            used = column > 0
            x = int(min(x, (left[used] // column[used]).min())) if used.any() else 0
            if x > 0:
                plan.append((x, column.astype(np.int64)))
                left -= x * column
    return plan + [(int(n), pattern) for n, pattern, _ in largest_first(lengths, left, capacity, whole=True)]


def placements(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, pieces per sequence, first sequence, first offset), in that order."""
    rows: list[tuple[int, int, int, int, int]] = []
    ranks, sequence = np.zeros(len(lengths), dtype=np.int64), 0
    for times, pattern in plan_patterns(lengths, demand, capacity):
        offset = 0
        for k in np.flatnonzero(pattern)[::-1]:
            rows.append((int(lengths[k]), int(ranks[k]), int(pattern[k]), sequence, offset))
            ranks[k] += times * pattern[k]
            offset += int(pattern[k] * lengths[k])
        sequence += times
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 48) + rank


def _cut_documents(path: str, end: int, capacity: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "local"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = tokens.tokenizer(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in gathered(batches, limit=CHUNK):
            ids, counts = encoder.encode(batch.column(batch.schema.get_field_index("text")), end)
            many = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), many)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            length = np.minimum(capacity, counts[doc] - start)
            at, raw = 4 * (np.repeat(np.cumsum(counts) - counts, many) + start), memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            found, first, times = np.unique(length[order], return_index=True, return_counts=True)
            local = np.empty(len(doc), np.int64)
            local[order] = np.arange(len(doc)) - np.repeat(first - seen[found], times)
            seen[found] += times
            docs = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([docs, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc]), pa.array(np.full(len(doc), part, np.int32)), pa.array(local)], names=names)

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are one piece, the end id. Very long texts give as
    many full pieces as they hold, and a tail. A null doc_id stays null;
    repeated rows are packed as often as they occur; pieces of equal length
    are interchangeable. Other columns of docs are not read. An empty table
    gives no rows.
    """
    tables = WorkTables(docs.sparkSession, "packing")
    lean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, local long"
    cut = tables.save(lean.mapInArrow(releasing(_cut_documents(tokenizer_path, end, capacity)), schema), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # a row for each length, of which there are `capacity` at most
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    lengths = np.asarray(sorted(histogram), dtype=np.int64)
    placed = placements(lengths, np.asarray([histogram[int(n)] for n in lengths], dtype=np.int64), capacity)
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("length", "part", before.alias("before"))
    ranked = cut.join(starts, ["length", "part"]).withColumn("rank", F.col("before") + F.col("local"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches):
        keys = _key(placed[:, 0], placed[:, 1])
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            length, rank = get("length").to_numpy(), get("rank").to_numpy()
            _, first, many, sequence, offset = placed[np.searchsorted(keys, _key(length, rank), side="right") - 1].T
            turn = rank - first
            yield pa.RecordBatch.from_arrays([*map(get, names[:5]), pa.array(sequence + turn // many), pa.array(offset + turn % many * length)], names=names)

    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
