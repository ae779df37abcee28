"""Gapless global numbers without a window over all rows (U-02, S-24)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Ranges of keys, and sampled keys for each.
RANGES, SAMPLE = 256, 16
#: Rows of a block by which a matrix is cut back into clips.
BLOCK = 1024


def prefix_sums(rows: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """rows (one for each key, none null) with `name`: the sum of n over all smaller keys.

    Keys are cut into RANGES ranges at keys of a sample, chosen by a hash so
    that reruns agree; sums run inside a range and over the ranges' totals. A
    sample of bounded size is collected while the plan is made.
    """
    sample = sorted(r[0] for r in rows.select(key).orderBy(F.xxhash64(key), key).limit(RANGES * SAMPLE).collect())
    cuts = sample[SAMPLE::SAMPLE]
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    before = lambda w: F.coalesce(F.sum(n).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranged = rows.withColumn("__range", place)
    totals = ranged.groupBy("__range").agg(F.sum(n).alias(n)).select("__range", before(W.orderBy("__range")).alias("__ahead"))
    own = ranged.withColumn("__own", before(W.partitionBy("__range").orderBy(key)))
    return own.join(totals, "__range").withColumn(name, (F.col("__ahead") + F.col("__own")).cast("long")).drop("__range", "__own", "__ahead")


def stack_clips(frames: DataFrame, key: str = "clip", order: str | list[str] = "frame") -> tuple[DataFrame, DataFrame]:
    """U-02: all clips one below the other, and the index that cuts them apart again.

    Gives frames with `row`, gapless from 0 in the order of (key, order), and
    the index (key, first_row, n_rows). No key is null; frames of one clip are
    ordered in one task.
    """
    sized = frames.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    index = prefix_sums(sized, key, "n_rows", "first_row").select(key, "first_row", "n_rows")
    place = F.row_number().over(W.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))) - 1
    stacked = frames.withColumn("__place", place).join(index.select(key, "first_row"), key)
    return stacked.withColumn("row", F.col("first_row") + F.col("__place")).drop("__place", "first_row"), index


def cut_apart(matrix: DataFrame, index: DataFrame, key: str = "clip", frame: str = "frame") -> DataFrame:
    """Rows of a stacked matrix (row, ...) with the key and frame (from 0) of their clip; an equi-join on blocks of rows."""
    ends = F.col("first_row") + F.col("n_rows") - 1
    blocks = F.sequence(F.floor(F.col("first_row") / BLOCK), F.floor(ends / BLOCK))
    spread = index.where("n_rows > 0").select(key, "first_row", ends.alias("__end"), F.explode(blocks).alias("__block"))
    joined = matrix.withColumn("__block", F.floor(F.col("row") / BLOCK)).join(spread, "__block").where("row BETWEEN first_row AND __end")
    return joined.withColumn(frame, F.col("row") - F.col("first_row")).drop("__block", "__end", "first_row")
