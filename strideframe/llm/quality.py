"""Quality rules by importance weights of hashed n-grams (operator 3).

Words and pairs of neighbouring words are hashed into BUCKETS. Two smoothed
multinomials over the buckets are counted: one over the whole corpus, one over
trusted documents. A document's score is the mean over its features of
log(trusted / corpus), so length does not matter. A document is kept where its
score reaches a threshold: the LOSS quantile of trusted scores, lowered half
way to the 99 % quantile of the rejected scores below it.

All labelled rows are used, however many. In the order of a hash every second
trusted document makes the multinomial and every other one fixes the
threshold, as do all rejected ones. Labels meet documents by a join, spared by
a filter of fixed size; quantiles are exact, by bins that narrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, hash_filter, in_filter, mix64, pieces, releasing, windows_hash, word_hashes
from .sharding import numbered

BUCKETS = 10_000
#: Share of trusted documents that may fall below the threshold.
LOSS = 0.001
#: Bins by which a quantile is narrowed in a round.
BINS = 1024
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT, WINDOW = 10, 20, 5
SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def _failed() -> Column:
    """The base rules, on the columns of SCORES."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def features(words: np.ndarray) -> np.ndarray:
    """Buckets of the words and pairs of a text."""
    pairs = windows_hash(words, 2, seed=2)
    return (np.concatenate([mix64(words), pairs]) % np.uint64(BUCKETS)).astype(np.int64)


def repeated_words(words: np.ndarray) -> int:
    """Words that lie in a window of five that occurs twice or more."""
    windows = windows_hash(words, WINDOW)
    if len(windows) < 2:
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    if counts.max() < 2:
        return 0
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[back] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks[:-1]) > 0).sum())


def base_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = word_hashes()
    total = np.zeros(BUCKETS, np.int64)
    for batch in pieces(batches):
        for raw in batch.column(batch.schema.get_field_index("text")).to_pylist():
            if raw:
                total += np.bincount(features(hashes.array(raw.split())), minlength=BUCKETS)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Features of all texts by bucket."""
    counts = np.zeros(BUCKETS)
    for row in rows.mapInArrow(releasing(_count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows at most
        counts[row["bucket"]] = row["n"]
    return counts


def _score(weights: np.ndarray):
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in pieces(batches):
            rows = []
            for doc, raw in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), batch.column(batch.schema.get_field_index("text")).to_pylist(), strict=True):
                words = hashes.array((raw or b"").split())
                score = float(weights[features(words)].mean()) if len(words) else 0.0
                rows.append((doc, len(words), *base_counts((raw or b"").decode("utf-8", "replace")), repeated_words(words), score))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 6 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def _usable(labels: DataFrame, quality: int) -> DataFrame:
    """doc_ids labelled `quality` and not toxic, each once, with the hash that orders them."""
    wanted = labels.where((F.col("quality") == quality) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("order", F.xxhash64("doc_id"))


def labelled(labels: DataFrame, quality: int) -> list[int]:
    """All doc_ids of _usable in their order, to look at the halves of a small table; no operator calls it."""
    return [r["doc_id"] for r in _usable(labels, quality).orderBy("order", "doc_id").collect()]


def marked(labels: DataFrame, tables: WorkTables) -> DataFrame:
    """One row per usable doc_id: fitted (makes the multinomial), held (a trusted one that fixes the threshold), rejected."""
    good = numbered(_usable(labels, 1), ["order", "doc_id"], tables)
    # a document that makes the multinomial would score too high for the threshold; a single one does both
    alone = good.count() == 1
    odd = F.col("__row") % 2 == 1
    halves = good.select("doc_id", (~odd).alias("fitted"), (odd | F.lit(alone)).alias("held"))
    both = halves.join(_usable(labels, 0).select("doc_id", F.lit(True).alias("rejected")), "doc_id", "full")
    return tables.save(both.select("doc_id", *(F.coalesce(x, F.lit(False)).alias(x) for x in ("fitted", "held", "rejected"))), "marks")


def met(lean: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows of lean whose doc_id is marked, with its marks. What the filter rules out is not shuffled."""
    filled = lean.sparkSession.sparkContext.broadcast(hash_filter(marks.select(F.xxhash64("doc_id").alias("hash"))))

    @F.pandas_udf("boolean")
    def maybe(hashes: pd.Series) -> pd.Series:
        return pd.Series(in_filter(filled.value, hashes.to_numpy().view(np.uint64)))

    return lean.where(maybe(F.xxhash64("doc_id"))).join(marks, "doc_id")


def quantile(scores: DataFrame, share: float) -> float | None:
    """The value of rank floor(share * (n - 1)) of column score; null for no rows.

    Each round counts BINS bins between the bounds and goes on with the one that
    holds the rank, until its bounds are equal.
    """
    low, high, n = scores.agg(F.min("score"), F.max("score"), F.count("score")).first()
    rank = int(share * (n - 1))
    while n and low < high:
        inner = scores.where(F.col("score").between(low, high))
        place = F.least(F.lit(BINS - 1), F.floor((F.col("score") - low) / (high - low) * BINS))
        for _, low, high, n in sorted(inner.groupBy(place.alias("bin")).agg(F.min("score"), F.max("score"), F.count("score")).collect()):  # BINS rows at most
            if rank < n:
                break
            rank -= n
    return low


def threshold(scores: DataFrame, loss: float = LOSS) -> float:
    """The lowest score that is kept, from (score, held, rejected); without trusted scores everything is."""
    edge = quantile(scores.where("held"), loss)
    if edge is None:
        return -np.inf
    below = quantile(scores.where("rejected").where(F.col("score") < edge), 0.99)
    return edge if below is None else (edge + below) / 2


class QualityModel(NamedTuple):
    """Log weight of each bucket, and the lowest score that is kept."""

    weights: np.ndarray
    edge: float


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Counts both multinomials and fixes the threshold, from all rows of docs and labels."""
    tables = WorkTables(docs.sparkSession, "quality")
    lean = _lean(docs)
    marks = marked(labels, tables)
    known = tables.save(met(lean, marks), "labelled")
    target = bucket_counts(known.where("fitted").select("text"))
    if not target.sum():
        return QualityModel(np.zeros(BUCKETS), -np.inf)
    total = bucket_counts(lean.select("text"))
    weights = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((total + 1) / (total.sum() + BUCKETS))
    scored = known.where("held OR rejected").select("doc_id", "text").mapInArrow(releasing(_score(weights)), SCORES)
    passed = scored.where(~_failed()).groupBy("doc_id").agg(F.min("score").alias("score")).join(marks, "doc_id")
    return QualityModel(weights, threshold(tables.save(passed.select("score", "held", "rejected"), "scores")))


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, the base columns, base_failed, kept, score.

    Words are runs of characters other than the six ASCII spaces, case kept.
    Null text has no words: score 0, base_failed true, kept false. Texts of any
    length are read whole. A score equal to the threshold is kept. A null
    doc_id is scored like any other row. Repeated rows are counted and
    returned each. Other columns of docs are not read. Without usable labels every score is 0 and only the base
    rules reject. An empty table gives no rows.
    """
    model = fit_quality(docs, labels)
    rows = _lean(docs).mapInArrow(releasing(_score(model.weights)), SCORES)
    kept = ~_failed() & (F.col("score") >= F.lit(model.edge))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"), kept.alias("kept"), "score")


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the documents that quality_digest rejects; all columns pass through, in one scan."""
    model = fit_quality(docs, labels)
    weights, edge = model.weights, model.edge

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = word_hashes()
        for batch in pieces(batches):
            hit = []
            for raw in batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist():
                words = hashes.array((raw or b"").split())
                good = len(words) >= MIN_WORDS and 100 * repeated_words(words) <= MAX_REPEAT * len(words)
                hit.append(good and float(weights[features(words)].mean()) >= edge)
            yield batch.filter(pa.array(hit, pa.bool_()))

    return docs.mapInArrow(releasing(keep), docs.schema)


def _lean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
