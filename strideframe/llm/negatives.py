"""Hard-negative mining by a pivot table (operator 11).

Components are whole numbers, so scores (inner products) are exact. With M the
largest norm, a vector x gets one more component sqrt(M^2 - |x|^2) and an
anchor q gets 0 there; then |q - x|^2 = |q|^2 + M^2 - 2 <q, x>, and a high
score is a short distance. The pivot table holds each row's distances to
PIVOTS pivots. By the triangle inequality they bracket the distance of any
anchor and row, and so the score: of two blocks by the ranges of their
distances, of a pair by the distances themselves. Only pairs whose bracket
meets what an anchor still looks for are scored. Pivots are rows far apart in
a sample of SAMPLE rows; any pivots give the same result.

A search deals rows into blocks of their nearest pivot, and anchors likewise.
First an anchor block meets one row block near it; what it finds there is the
floor for the second step, in which it meets every other block whose bracket
reaches the floor. Blocks are bounded by rows, a hot label or pivot has more of
them, and a pair of blocks returns the best few of each anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WorkTables

PIVOTS, SAMPLE = 8, 512
#: Anchors and rows of a block; scores that a task holds at a time.
ANCHORS, ROWS, SCORES = 4096, 4096, 1 << 20
#: Share of pairs left by the brackets up to which single pairs are scored, not the block.
FEW = 0.05
#: Norms stay below this, so that every score is a long.
LONGEST = 2.0**31
LOWEST, HIGHEST = -(2**63), 2**63 - 1
TABLE = "row long, vec_id long, label long, vector binary, square double, near array<double>, asked array<double>, cell int"
FOUND = "row long, need int, score long, other long, other_row long"


def _whole(batches):
    """row, vec_id, label, floor(256 x) as doubles' bytes and squared norm; rows with null or non-finite components, or too long, are left out."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("embedding"))
        sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        values = np.floor(256.0 * pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False))
        first = np.cumsum(sizes) - sizes
        vectors, squares, kept = [], [], []
        for k, (low, n) in enumerate(zip(first.tolist(), sizes.tolist(), strict=True)):
            own = values[low : low + n]
            if np.isfinite(own).all() and (not n or np.abs(own).max() < LONGEST) and (square := float(own @ own)) < LONGEST**2:
                vectors.append(own.tobytes())
                squares.append(square)
                kept.append(k)
        at = pa.array(kept, pa.int64())
        columns = [batch.column(batch.schema.get_field_index(x)).take(at) for x in ("row", "vec_id", "label")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(vectors, pa.binary()), pa.array(squares, pa.float64())], names=["row", "vec_id", "label", "vector", "square"])


def stacked(column, width: int = 0) -> np.ndarray:
    """Vectors as rows, with zeros up to the longest of them (or width)."""
    buffers = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
    width = max([width, *(len(x) for x in buffers)])
    if all(len(x) == width for x in buffers):
        return np.stack(buffers) if buffers else np.zeros((0, width))
    out = np.zeros((len(buffers), width))
    for k, x in enumerate(buffers):
        out[k, : len(x)] = x
    return out


def far_apart(sample: np.ndarray, squares: np.ndarray, top: float, count: int = PIVOTS) -> np.ndarray:
    """Rows of the sample, each the one farthest from those before it."""
    lift = np.sqrt(np.maximum(top - squares, 0))
    chosen, least = [0], np.full(len(sample), np.inf)
    while len(chosen) < count:
        k = chosen[-1]
        least = np.minimum(least, ((sample - sample[k]) ** 2).sum(axis=1) + (lift - lift[k]) ** 2)
        chosen.append(int(least.argmax()))
    return np.asarray(chosen)


def _distances(pivots: np.ndarray, lifts: np.ndarray, top: float):
    """Distances of the lengthened rows (near) and of the rows as anchors (asked) to the pivots, and the nearest pivot."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = stacked(batch.column(batch.schema.get_field_index("vector")), pivots.shape[1])
            squares = batch.column(batch.schema.get_field_index("square")).to_numpy()
            wide = np.zeros((len(pivots), vectors.shape[1]))
            wide[:, : pivots.shape[1]] = pivots
            flat = np.stack([((vectors - p) ** 2).sum(axis=1) for p in wide], axis=1)
            lift = np.sqrt(np.maximum(top - squares, 0))
            near, asked = np.sqrt(flat + (lift[:, None] - lifts) ** 2), np.sqrt(flat + lifts**2)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(pivots)).cast(pa.list_(pa.float64())) for x in (near, asked)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(near.argmin(axis=1).astype(np.int32))], names=[*batch.schema.names, "near", "asked", "cell"])

    return run


def pivot_table(table: DataFrame, label: Column, tables: WorkTables) -> tuple[DataFrame, float]:
    """The rows that take part, with their distances to the pivots; and M^2."""
    lean = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    lean = lean.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    rows = tables.save(lean.mapInArrow(_whole, "row long, vec_id long, label long, vector binary, square double"), "rows")
    top = rows.agg(F.max("square")).first()[0] or 0.0
    sample = rows.orderBy(F.xxhash64("vec_id"), "row").limit(SAMPLE).select("vector", "square").toArrow()
    pivots, lifts = np.zeros((1, 1)), np.zeros(1)
    if sample.num_rows:
        vectors, squares = stacked(sample.column("vector").combine_chunks()), sample.column("square").to_numpy()
        chosen = far_apart(vectors, squares, top)
        pivots, lifts = vectors[chosen], np.sqrt(np.maximum(top - squares[chosen], 0))
    return tables.save(rows.mapInArrow(_distances(pivots, lifts, top), TABLE), "pivots"), top


def best_of(asked, rows, lows, highs, k: int, top: float, same: bool) -> tuple[np.ndarray, ...]:
    """(anchor, need, score, row) of the k best of each need among the rows.

    asked, rows: dicts of arrays (row, vec_id, label, vector, square, and the
    anchors' or rows' distances to the pivots as `to`). lows, highs: per anchor
    its needs' bounds of the score, both inclusive.
    """
    exact = top < 2.0**53
    anchors, others = (x["vector"] if exact else x["vector"].astype(np.int64) for x in (asked, rows))
    banded = max((int(x.max()) for x in highs if len(x)), default=LOWEST) < HIGHEST
    slack = 1e-9 * (top + float(asked["square"].max())) + 1
    step = max(1, SCORES // len(rows["row"]))
    out = []
    for low in range(0, len(anchors), step):
        part = slice(low, low + step)
        squares, to = asked["square"][part], asked["to"][part]
        least = np.asarray([x.min() for x in lows[part]], np.float64)
        most = np.asarray([x.max() for x in highs[part]], np.float64)
        apart = np.zeros((len(to), len(others)))
        reach = np.full((len(to), len(others)), np.inf)
        for j in range(to.shape[1]):
            np.maximum(apart, np.abs(to[:, j, None] - rows["to"][None, :, j]), out=apart)
            if banded:
                np.minimum(reach, to[:, j, None] + rows["to"][None, :, j], out=reach)
        middle = ((squares + top) / 2)[:, None]
        alive = middle - apart**2 / 2 + slack >= least[:, None]
        if banded:
            alive &= middle - reach**2 / 2 - slack <= most[:, None]
        alike = asked["label"][part][:, None] == rows["label"][None, :]
        alive &= (alike if same else ~alike) & (asked["row"][part][:, None] != rows["row"][None, :])
        if alive.mean() > FEW:
            scores = anchors[part] @ others.T
        else:
            scores = np.zeros(alive.shape, anchors.dtype)
            a, b = np.nonzero(alive)
            for at in range(0, len(a), 1 << 15):
                x, y = a[at : at + (1 << 15)], b[at : at + (1 << 15)]
                scores[x, y] = np.einsum("ij,ij->i", anchors[part][x], others[y])
        for a in np.flatnonzero(alive.any(axis=1)).tolist():
            open_at = np.flatnonzero(alive[a])
            score = scores[a, open_at].astype(np.int64)
            for need, (floor, ceiling) in enumerate(zip(lows[low + a].tolist(), highs[low + a].tolist(), strict=True)):
                fit = np.flatnonzero((score >= floor) & (score <= ceiling))
                if len(fit) > k:
                    fit = fit[score[fit] >= np.partition(score[fit], -k)[-k]]
                at = open_at[fit]
                order = np.lexsort((rows["row"][at], rows["vec_id"][at], -score[fit]))[:k]
                out += [(low + a, need, int(score[fit[x]]), int(at[x])) for x in order]
    return tuple(np.asarray(x, np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 4


def _arrays(part: pa.Table, to: str, width: int) -> dict[str, np.ndarray]:
    get = lambda name: part.column(name).combine_chunks()
    flat = get(to).flatten().to_numpy()
    return {x: get(x).to_numpy() for x in ("row", "vec_id", "label", "square")} | {"vector": stacked(get("vector"), width), "to": flat.reshape(part.num_rows, -1)}


def _ranges(name: str) -> list[Column]:
    return [F.array(*(f(F.element_at(name, j + 1)) for j in range(PIVOTS))) for f in (F.min, F.max)]


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """rows with part: their block within (kin, cell), of about `size` rows each."""
    parts = rows.groupBy("kin", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    return rows.join(parts, ["kin", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts").cast("int")).drop("parts")


def search(needs: DataFrame, table: DataFrame, k: int, top: float, same: bool, tables: WorkTables) -> DataFrame:
    """The k best rows of each anchor and need: row, need, score, other, other_row, rank.

    needs: rows of the pivot table with lows and highs, arrays of the bounds
    that the score must keep. same: rows of the anchor's label, or of the other
    labels. Ties go by vec_id, then by row.
    """
    kin = F.col("label") if same else F.lit(0).cast("long")
    rows = tables.save(_blocks(table.withColumn("kin", kin), ROWS), "row_blocks")
    # few anchors are one block, whichever pivots they are near: each block costs a copy of the rows
    groups = lambda n: F.least(F.lit(PIVOTS), F.greatest(F.lit(1), F.floor(n / ANCHORS))).cast("int")
    spread = needs.withColumn("kin", kin)
    if same:
        spread = spread.join(spread.groupBy("kin").agg(groups(F.count(F.lit(1))).alias("groups")), "kin")
    else:
        spread = spread.withColumn("groups", groups(F.lit(needs.count())))
    spread = spread.withColumns({"home": F.col("cell"), "cell": F.col("cell") % F.col("groups")}).drop("groups")
    asked = tables.save(_blocks(spread, ANCHORS), "need_blocks")
    low, high = _ranges("near")
    of_rows = rows.groupBy("kin", "cell", "part").agg(low.alias("low"), high.alias("high"))
    of_rows = tables.save(of_rows.select("kin", F.col("cell").alias("row_cell"), F.col("part").alias("row_part"), "low", "high"), "row_ranges")

    def ranged(asked: DataFrame) -> DataFrame:
        low, high = _ranges("asked")
        found = asked.groupBy("kin", "cell", "part").agg(
            low.alias("ask_low"), high.alias("ask_high"), F.max("square").alias("square"), F.min("square").alias("least_square"), F.mode("home").alias("home"),
            F.min(F.array_min("lows")).alias("floor"), F.max(F.array_max("highs")).alias("ceiling"),
        )
        return found.withColumn("row_cell", F.explode(F.sequence(F.lit(0), F.lit(PIVOTS - 1))))

    def met(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = pairs.select("kin", "cell", "part", "row_cell", "row_part")
        pairs = tables.save(pairs.withColumn("pair", F.concat_ws(":", "kin", "cell", "part", "row_cell", "row_part")), "pairs")
        left = asked.join(pairs, ["kin", "cell", "part"]).select("pair", "row", "vec_id", "label", "vector", "square", "asked", "lows", "highs")
        right = rows.join(pairs.drop("cell", "part").withColumnsRenamed({"row_cell": "cell", "row_part": "part"}), ["kin", "cell", "part"])
        right = right.select(F.col("pair").alias("same_pair"), "row", "vec_id", "label", "vector", "square", "near")

        def compare(one: pa.Table, other: pa.Table) -> pa.Table:
            a, b = (_arrays(x, to, 0) for x, to in ((one, "asked"), (other, "near")))
            width = max(a["vector"].shape[1], b["vector"].shape[1])
            for x in (a, b):
                x["vector"] = np.pad(x["vector"], ((0, 0), (0, width - x["vector"].shape[1])))
            lows, highs = ([np.asarray(x.values.to_numpy(), np.int64) for x in one.column(name).combine_chunks()] for name in ("lows", "highs"))
            anchor, need, score, at = best_of(a, b, lows, highs, k, top, same)
            return pa.table({"row": a["row"][anchor], "need": need.astype(np.int32), "score": score, "other": b["vec_id"][at], "other_row": b["row"][at]})

        return tables.save(left.groupBy("pair").cogroup(right.groupBy("same_pair")).applyInArrow(compare, FOUND), "found")

    near = (F.col("row_cell") == F.col("home")) & (F.col("row_part") == 0)
    first = met(asked, ranged(asked).where("row_cell = home").join(of_rows, ["kin", "row_cell"]).where(near))
    order = W.partitionBy("row", "need").orderBy(F.desc("score"), "other", "other_row")
    floors = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k)
    floors = floors.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("need", "score"))).alias("floors"))  # a few needs an anchor
    raised = F.transform("lows", lambda x, i: F.greatest(x, F.coalesce(F.element_at("floors", i.cast("int")), x)))
    lifted = tables.save(asked.join(floors, "row", "left").withColumn("lows", raised).drop("floors"), "need_blocks")
    both = ranged(lifted).join(of_rows, ["kin", "row_cell"]).where(~near)
    apart = F.array_max(F.zip_with(F.zip_with("ask_low", "high", lambda a, b: a - b), F.zip_with("low", "ask_high", lambda a, b: a - b), lambda a, b: F.greatest(a, b)))
    reach = F.array_min(F.zip_with("ask_high", "high", lambda a, b: a + b))
    slack = 1e-9 * (F.lit(top) + F.col("square")) + 1
    upper = (F.col("square") + top - F.pow(F.greatest(apart, F.lit(0.0)), 2)) / 2 + slack
    lower = (F.col("least_square") + top - F.pow(reach, 2)) / 2 - slack
    second = met(lifted, both.where((upper >= F.col("floor").cast("double")) & (lower <= F.col("ceiling").cast("double"))))
    return first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(table: DataFrame, label: Column, anchor: Column, positives: int = 5, negatives: int = 3, tables: WorkTables | None = None) -> DataFrame:
    """Per anchor and positive its hard negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    label and anchor are expressions over vec_id and label. An anchor's
    positives are the first others of its label by score, then vec_id; its hard
    negatives the first of other labels whose score is 50 to 95 % of the
    positive's. Rows with a null vec_id, label, vector or component, or a
    non-finite one, take no part, nor do those of norm 2^31 or more, as their
    scores are no longs. Of vectors of unlike length the shorter counts as
    filled with zeros; an empty one scores 0. Rows that share a vec_id are rows
    of their own: each may be an anchor, and the positive or negative of the
    others. Other columns are not read. An empty table gives no rows.
    """
    tables = tables or WorkTables(table.sparkSession, "negatives")
    pivots, top = pivot_table(table, label, tables)
    anchors = pivots.where(anchor)
    one = anchors.withColumns({"lows": F.array(F.lit(LOWEST).cast("long")), "highs": F.array(F.lit(HIGHEST).cast("long"))})
    first = tables.save(search(one, pivots, positives, top, True, tables), "positives")
    # 50 p <= 100 n <= 95 p without products that leave the longs
    p = F.col("score")
    low, high = F.expr("(score + pmod(score, 2)) div 2"), p - F.expr("(score + pmod(-score, 20)) div 20")
    bound = first.withColumns({"low": low, "high": high})
    wanted = bound.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "low", "high"))).alias("x"))  # `positives` of them at most
    two = anchors.join(wanted, "row").withColumns({"lows": F.col("x.low"), "highs": F.col("x.high")}).drop("x")
    second = search(two, pivots, negatives, top, False, tables)
    mine = first.select("row", (F.col("rank") - 1).alias("need"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    named = second.join(mine, ["row", "need"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return named.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def negative_digest(table: DataFrame) -> DataFrame:
    """hard_negatives of rows whose vec_id 50 divides; where 7 divides it, the label is moved on by one of 10."""
    label = F.col("label").cast("decimal(20,0)")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(table, moved, F.col("vec_id") % 50 == 0)


SQL = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS other_id, a.label = o.label AS same, CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM usable a JOIN usable o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
