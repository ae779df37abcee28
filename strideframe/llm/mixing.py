"""Mixing sources to target weights by systematic sampling (operator 1).

Every document of a source has the same expected number of copies,
e = target / source size. Documents are laid out in a fixed order within their
source; the running sum of e, shifted by one offset per source, crosses an
integer boundary once per copy that is emitted.

The order groups documents of similar size (a power of two and its two next
bits), so the words taken miss a target by little. The running sum needs no
task that holds a whole source: ranks are taken inside small groups (source,
size class, hashed chunk), and only one row per group is summed per source:
some 40 * CHUNKS rows at most, however many documents. Sources are expected to
be some thousands at most, as targets are set over one row for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import sealed, word_count

#: Weights that sources take in turn, in code-point order of their names.
WEIGHTS = (3, 1, 2)
#: Words to take over all sources, as a share of all words.
SHARE = 1.5
#: No source, and no document, gives more than this many times its words.
CAP = 2
#: Chunks of a size class, by a hash of doc_id (of the text, where that is null); one running sum per source is over these.
CHUNKS = 1024


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("~"))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Columns __src, source_size, target from one row (__src, source_size) per source.

    Water-filling: a source stops at cap times its size and the excess is
    shared again by weight, until none is above. The windows run over one row
    per source, not per document.
    """
    order = W.orderBy("__src")
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (turn + 1).cast("int"))
    line = W.orderBy("__ratio", "__src")
    ranked = (
        sizes.withColumn("__w", w.cast("long"))
        .withColumn("__cap", F.col("source_size") * cap)
        .withColumn("__ratio", F.col("__cap").cast("double") / F.col("__w"))
        .withColumn("__full", F.sum("__cap").over(line.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("__left", F.sum("__w").over(line.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("__all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("__level", (F.col("__all") * F.lit(float(share)) - F.coalesce("__full", F.lit(0))) / F.col("__left"))
        .withColumn("__rank", F.row_number().over(line))
    )
    found = F.min(F.when(F.col("__ratio") >= F.col("__level"), F.struct("__rank", "__level"))).over(W.partitionBy())
    level = F.coalesce(found["__level"], F.lit(float("inf")))
    return ranked.select("__src", "source_size", F.least(F.col("__cap").cast("double"), level * F.col("__w")).alias("target"))


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = 1, chunks: int = CHUNKS) -> DataFrame:
    """docs with size, source_size, target and copies (how often the mix takes each row).

    Null text counts 0 words; a null source is a source of its own, last in
    order; rows without a doc_id come first, by their texts. Rows that agree in
    source, size and doc_id are interchangeable: one of them may get a copy more. Sources
    without words get target 0 and no copies. Columns of docs with one of
    those four names are replaced; no other name can clash. Texts of any length
    are counted whole. An empty table gives no rows.
    """
    own = ["size", "source_size", "target", "copies"]
    docs = docs.drop(*own)
    inner = [c if c in ("doc_id", "source", "text") else f"column_{k}" for k, c in enumerate(docs.columns)]
    out = _mixed(docs.toDF(*inner), weights, share, cap, seed, chunks)
    return out.select(*inner, *own).toDF(*docs.columns, *own)


def _mixed(docs: DataFrame, weights, share: float, cap: int, seed: int, chunks: int) -> DataFrame:
    size = word_count(F.col("text"))
    bits = F.length(F.bin(F.col("size")))
    # fixed value: the multiplier of the minimal standard generator modulo 2^31 - 1
    hashed = F.pmod(F.pmod(F.col("doc_id").cast("long"), F.lit(2147483647)) * 48271, F.lit(2147483647))
    by_text = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long")
    keyed = docs.withColumns({"size": size, "__src": _key(F.col("source"))})
    keyed = keyed.withColumns({
        "__class": (bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))")).cast("int"),
        "__turn": F.when(F.col("doc_id").isNull(), by_text),
        "__chunk": F.pmod(F.coalesce(hashed, by_text, F.lit(0)), F.lit(chunks)).cast("int"),
    })
    key = ["__src", "__class", "__chunk"]
    groups = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__words"))
    by_source = groups.groupBy("__src").agg(F.sum("__words").alias("source_size"))
    plan = source_targets(by_source, weights, share, cap).withColumns({
        "__e": F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)),
        "__u": F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("__src")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0),
    })
    before = F.coalesce(F.sum("__n").over(W.partitionBy("__src").orderBy("__class", "__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = groups.select(*key, before.alias("__before")).join(plan, "__src")
    ranked = keyed.withColumn("__rank", F.row_number().over(W.partitionBy(*key).orderBy("size", "doc_id", "__turn")))
    crossed = F.floor((F.col("__i")) * F.col("__e") + F.col("__u")) - F.floor((F.col("__i") - 1) * F.col("__e") + F.col("__u"))
    out = ranked.join(starts, key).withColumn("__i", (F.col("__before") + F.col("__rank")).cast("double"))
    # e is cap at most, so no more boundaries are crossed but by rounding of the running sum
    copies = F.when(crossed <= cap + 1, F.least(crossed, F.lit(int(cap)))).otherwise(F.raise_error(F.lit("more copies than the cap")))
    return out.withColumn("copies", copies.cast("long"))


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of docs, each row as often as it is taken."""

    def emit(rows: DataFrame) -> DataFrame:
        taken = mixed(rows, **how).where(F.col("copies") > 0)
        return taken.withColumn("__copy", F.explode(F.expr("array_repeat(0, cast(copies AS int))")))

    return sealed(docs, ("doc_id", "source", "text"), emit)


SQL = r"""
WITH d AS (
  SELECT doc_id, text, coalesce('s' || source, '~') AS src,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
k AS (
  SELECT *, CAST(length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 3, 0)) AS INTEGER) AS cls,
         coalesce(((doc_id % 2147483647 + 2147483647) % 2147483647) * 48271 % 2147483647, ('0x' || substr(md5(text), 1, 8))::BIGINT, 0) % 1024 AS chunk
  FROM d),
s AS (SELECT src, sum(size)::BIGINT AS source_size FROM k GROUP BY src),
w AS (
  SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY src) - 1) % 3] AS w, source_size * 2 AS cap FROM s),
r AS (SELECT *, cap::DOUBLE / w AS ratio FROM w),
l AS (
  SELECT *, row_number() OVER o AS rk,
         (sum(source_size) OVER () * 1.5::DOUBLE
           - coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
         / (sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS lev
  FROM r WINDOW o AS (ORDER BY ratio, src)),
t AS (
  SELECT src, source_size, least(cap::DOUBLE,
           coalesce((SELECT lev FROM l WHERE ratio >= lev ORDER BY rk LIMIT 1), 'inf'::DOUBLE) * w) AS target
  FROM l),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS e,
         ('0x' || substr(md5('1:' || src), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM t),
i AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.e, e.u,
         (row_number() OVER (PARTITION BY k.src ORDER BY cls, chunk, size, doc_id NULLS FIRST, md5(text) NULLS FIRST))::DOUBLE AS i
  FROM k JOIN e USING (src))
SELECT doc_id, size, source_size, target,
       CAST(least(floor(i * e + u) - floor((i - 1) * e + u), 2) * size AS BIGINT) AS taken
FROM i
"""


def mixing_digest(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    lean = docs.select("doc_id", "source", "text")
    out = mixed(lean, **how)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
