"""Embedding near-duplicates by spherical-cap filters (operator 10).

A filter is a direction; a unit vector passes it where their inner product
reaches ALPHA. Directions are structured: after a random rotation a vector is
cut in PARTS parts, each part has a code of B random unit vectors, and every
choice of one code word a part, scaled to unit length, is a direction. So
B ** PARTS filters cost PARTS * B inner products: decoding lists all choices
whose parts' scores sum to the threshold, part by part, pruning by the best
that the parts to come can add. ROTATIONS independent codes make up for
vectors that lie badly to one.

B grows with the cube root of the number of vectors, and ALPHA is set so that a
random vector passes FILTERS filters of each code; so the chance company in a
bucket stays LOAD whatever the size. Where that would lose more than MISSED of
the pairs at the wanted cosine (vectors of few dimensions), ALPHA is lowered
until it does not, and buckets grow. Vectors are filled with zeros to the next
of few lengths, so that few codes are planned, however ragged the table.

Candidates share a filter; all are verified by cosine in double precision.
Vectors with equal components are one class with a count. Buckets of up to
SMALL members list their pairs. Larger ones are verified in blocks of two
chunks that meet in one task: a block returns how many links each vector has,
and a spanning set of links, never its pairs. A pair that shares several
buckets is counted once: not in a block if it shares a small bucket or a
larger one of smaller number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, per_worker
from .components import components

PARTS, ROTATIONS, FILTERS, LOAD = 3, 6, 12.0, 0.6
SMALL, CHUNK = 12, 256
#: Random vectors, and pairs at the wanted cosine, on which ALPHA is set; share of such pairs that may be missed.
TRIALS, MISSED = 400, 0.005
#: Scores that decoding holds at a time.
SCORES = 1 << 19


def filled(dim: int) -> int:
    """The length to which vectors are filled: 12, 16, 24, 32, 48, 64, ..."""
    low = 12
    while low < dim:
        low = low * 4 // 3 if low % 3 == 0 else low * 3 // 2
    return low


def code_book(dim: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation (dim, dim) and the parts' codes (size, width), scaled so that scores add up to inner products."""
    return per_worker("codes", (dim, size, seed), lambda: _code_book(dim, size, seed))


def _code_book(dim: int, size: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    rng = np.random.default_rng([seed, dim, size])
    rotation, _ = np.linalg.qr(rng.normal(size=(dim, dim)))
    codes = []
    for width in np.diff(np.arange(PARTS + 1) * dim // PARTS):
        code = rng.normal(size=(size, width))
        codes.append(code / np.linalg.norm(code, axis=1, keepdims=True) / np.sqrt(PARTS))
    return rotation, codes


def decode(vectors: np.ndarray, size: int, seed: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, number) of every filter of one code that a unit vector passes, sorted by row."""
    rotation, codes = code_book(filled(vectors.shape[1]), size, seed)
    turned = vectors @ rotation[: vectors.shape[1]]
    scores, at = [], 0
    for code in codes:
        scores.append(turned[:, at : at + code.shape[1]] @ code.T)
        at += code.shape[1]
    best = np.stack([s.max(axis=1) for s in scores])
    row, number, total = np.arange(len(vectors)), np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    for k, s in enumerate(scores):
        # words that can be part of a choice at all, and then sums that later parts can still lift to alpha
        near_row, near = np.nonzero(s >= (alpha - best.sum(axis=0) + best[k])[:, None])
        many = np.bincount(near_row, minlength=len(vectors))
        first = np.cumsum(many) - many
        each = many[row]
        upto = np.cumsum(each)
        take = np.repeat(first[row] - (upto - each), each) + np.arange(upto[-1] if len(upto) else 0)
        row, number, total = np.repeat(row, each), np.repeat(number, each) * size + near[take], np.repeat(total, each) + s[near_row[take], near[take]]
        fit = total >= alpha - best[k + 1 :].sum(axis=0)[row]
        row, number, total = row[fit], number[fit], total[fit]
    return row, number


def plan_code(dim: int, count: int, cosine: float) -> tuple[int, float]:
    """B and ALPHA for `count` vectors of `dim` dimensions."""
    size = int(max(8, np.ceil((count * FILTERS / LOAD) ** (1 / PARTS))))
    rng = np.random.default_rng([dim, size])
    one, other = rng.normal(size=(2, TRIALS, dim))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    other -= (one * other).sum(axis=1, keepdims=True) * one
    norm = np.linalg.norm(other, axis=1, keepdims=True)
    other = cosine * one + np.sqrt(1 - cosine**2) * np.divide(other, norm, out=np.zeros_like(other), where=norm > 1e-9)
    if dim == 1:
        other = one
    alpha = 1.0
    for step in (0.02, 0.002):
        while alpha > 0 and len(decode(one, size, 0, alpha)[0]) < FILTERS * TRIALS:
            alpha -= step
        alpha += 0.02 if step > 0.01 else 0
    while alpha > 0:
        met = np.zeros(TRIALS, bool)
        for seed in range(ROTATIONS):
            (a, x), (b, y) = decode(one, size, seed, alpha), decode(other, size, seed, alpha)
            whole = size**PARTS
            met[np.intersect1d(a * whole + x, b * whole + y) // whole] = True
        if met.mean() >= 1 - MISSED:
            break
        alpha -= 0.02
    return size, alpha


def _plans(cosine: float):
    def run(batches):
        for batch in batches:
            found = [plan_code(d, n, cosine) for d, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.float64())], names=["d", "size", "alpha"])

    return run


def _unit(batches):
    """vec_id, the bytes of the unit vector, hash of the components; null where the vector links with nothing."""
    for batch in batches:
        ids, column = batch.column(batch.schema.get_field_index("vec_id")), batch.column(batch.schema.get_field_index("embedding"))
        n = batch.num_rows
        sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = pc.fill_null(column.flatten(), np.nan).to_numpy(zero_copy_only=False)
        first = np.cumsum(sizes) - sizes
        unit = np.full(n, None, object)
        # rows that link with nothing keep apart from each other
        high, low = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64).copy(), np.zeros(n, np.int64)
        for dim in np.unique(sizes[sizes > 0]):
            at = np.flatnonzero(sizes == dim)
            raw = values[first[at][:, None] + np.arange(dim)]
            top = np.abs(raw).max(axis=1)
            good = np.isfinite(raw).all(axis=1) & (top > 0)
            at, raw, top = at[good], raw[good], top[good][:, None]
            with np.errstate(over="ignore"):
                norm = np.linalg.norm(raw / top, axis=1, keepdims=True) * top
            good = np.isfinite(norm[:, 0])
            at, raw, norm = at[good], raw[good] + 0.0, norm[good]
            for k, vector, own in zip(at.tolist(), raw / norm, raw, strict=True):
                unit[k] = vector.tobytes()
                digest = xxhash.xxh3_128_digest(own.tobytes())
                high[k], low[k] = int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)
        yield pa.RecordBatch.from_arrays([ids, pa.array(unit, pa.binary()), pa.array(high), pa.array(low)], names=["vec_id", "unit", "high", "low"])


def _stacked(column: pa.Array) -> np.ndarray:
    """Vectors of equal length, one a row."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _filters(plans: dict[int, tuple[int, float]]):
    def run(batches):
        for batch in batches:
            units = batch.column(batch.schema.get_field_index("unit"))
            dims = pc.binary_length(units).to_numpy() // 8
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                size, alpha = plans[filled(int(dim))]
                step = max(8, SCORES // (PARTS * size))
                for low in range(0, len(rows), step):
                    some = pa.array(rows[low : low + step])
                    vectors = _stacked(units.take(some))
                    parts = [decode(vectors, size, seed, alpha) for seed in range(ROTATIONS)]
                    row = np.concatenate([x for x, _ in parts])
                    # number of the filter, beyond those of other codes; the dimension keeps lengths apart
                    number = np.concatenate([x + seed * size**PARTS for seed, (_, x) in enumerate(parts)]) * 65536 + dim % 65536
                    order = np.argsort(row, kind="stable")
                    offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(some)))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(number[order]))
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")).take(some), lists], names=["node", "filters"])

    return run


def _verify(cosine: float):
    def run(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            dims, others = (pc.binary_length(get(x)).to_numpy() for x in ("ua", "ub"))
            hit = np.zeros(batch.num_rows, bool)
            for dim in np.unique(dims):
                at = np.flatnonzero((dims == dim) & (others == dim))
                if len(at):
                    one, other = (_stacked(get(x).take(pa.array(at))) for x in ("ua", "ub"))
                    hit[at] = np.einsum("ij,ij->i", one, other) >= cosine
            yield pa.RecordBatch.from_arrays([get("a"), get("b"), get("ca"), get("cb")], names=["a", "b", "ca", "cb"]).filter(pa.array(hit))

    return run


def block_links(cosine: float, current: int, nodes, counts, chunks, vectors, filters, small) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links each row gains in this block, and links that join what the block links.

    filters: per row the numbers of its larger buckets; small: of its small ones.
    """
    n = len(nodes)
    one = chunks == chunks.min()
    apart = ~one.all()
    linked = vectors @ vectors.T >= cosine
    np.fill_diagonal(linked, False)
    if apart:
        linked &= one[:, None] != one[None, :]
    before = [np.concatenate([s, f[f < current]]) for s, f in zip(small, filters, strict=True)]
    numbers, place = np.unique(np.concatenate(before), return_inverse=True)
    member = np.zeros((n, max(1, len(numbers))), np.float32)
    member[np.repeat(np.arange(n), [len(x) for x in before]), place] = 1
    member = member[:, member.sum(axis=0) > 1]
    fresh = linked & (member @ member.T == 0) if member.shape[1] else linked
    gained = fresh @ counts
    label = np.arange(n)
    while True:
        best = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        best = best[best]
        if (best == label).all():
            break
        label = best
    return gained, [(int(nodes[k]), int(nodes[label[k]])) for k in np.flatnonzero(label != np.arange(n))]


def embedding_duplicates(table: DataFrame, cosine: float = 0.95) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Null or zero vectors, and those with null or non-finite components, link
    with nothing; so do vectors of unlike length. A cosine of exactly `cosine`
    (in double precision) links. Other columns of the table are not read. Rows that share a vec_id are
    one node, though each counts as a link of its equals. A null vec_id links
    with nothing: 0 links, null component, kept true. An empty table gives no
    rows.
    """
    tables = WorkTables(table.sparkSession, "embdup")
    lean = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = tables.save(lean.mapInArrow(_unit, "vec_id long, unit binary, high long, low long"), "unit")
    usable = rows.where("unit IS NOT NULL AND vec_id IS NOT NULL")
    classes = tables.save(usable.groupBy("high", "low").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("unit").alias("unit")), "classes")
    by_length = classes.groupBy(F.expr("cast(octet_length(unit) / 8 as int)").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    # the lengths to which vectors are filled: some twenty, whatever the table
    top = by_length.agg(F.max("d")).first()[0] or 0
    steps = [12]
    while steps[-1] < top:
        steps.append(filled(steps[-1] + 1))
    # the least length of each, as fewer dimensions ask for a lower threshold
    step = F.element_at(F.filter(F.array(*map(F.lit, steps)), lambda x: x >= F.col("d")), 1)
    wanted = by_length.groupBy(step.alias("step")).agg(F.min("d").cast("long").alias("d"), F.sum("n").alias("n")).select("d", "n")
    plans = {filled(r["d"]): (r["size"], r["alpha"]) for r in wanted.mapInArrow(_plans(cosine), "d long, size long, alpha double").collect()}
    passed = tables.save(classes.select("node", "unit").mapInArrow(_filters(plans), "node long, filters array<long>"), "filters")
    listed = passed.select("node", F.explode("filters").alias("filter"))
    shared = listed.groupBy("filter").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    members = tables.save(listed.join(shared, "filter"), "members")
    vectors = classes.select("node", "copies", "unit")

    few = members.where(F.col("members") <= SMALL).select("filter", F.col("node").alias("a"))
    pairs = few.join(few.withColumnRenamed("a", "b"), "filter").where("a < b").select("a", "b").distinct()
    left = vectors.select(F.col("node").alias("a"), F.col("copies").alias("ca"), F.col("unit").alias("ua"))
    right = vectors.select(F.col("node").alias("b"), F.col("copies").alias("cb"), F.col("unit").alias("ub"))
    links = tables.save(pairs.join(left, "a").join(right, "b").select("a", "b", "ca", "cb", "ua", "ub").mapInArrow(_verify(cosine), "a long, b long, ca long, cb long"), "links")

    by_node = members.groupBy("node").agg(
        F.sort_array(F.collect_list(F.when(F.col("members") > SMALL, F.col("filter")))).alias("filters"),
        F.collect_list(F.when(F.col("members") <= SMALL, F.col("filter"))).alias("small"),
    )  # a vector passes ROTATIONS * FILTERS filters or so
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    large = members.where(F.col("members") > SMALL).withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = large.select("filter", "node", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    full = dealt.join(vectors.join(by_node, "node"), "node")

    def compare(part: pa.Table) -> pa.Table:
        get = lambda name: part.column(name).combine_chunks()
        lists = [[np.asarray(x.values.to_numpy(), np.int64) for x in get(name)] for name in ("filters", "small")]
        stacked = np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in get("unit")])
        nodes = get("node").to_numpy()
        gained, joined = block_links(cosine, get("filter")[0].as_py(), nodes, get("copies").to_numpy(), get("chunk").to_numpy(), stacked, *lists)
        at = np.flatnonzero(gained)
        none = [None] * len(at)
        return pa.table({
            "node": pa.array([*nodes[at].tolist(), *[None] * len(joined)], pa.int64()),
            "gained": pa.array([*gained[at].tolist(), *[0] * len(joined)], pa.int64()),
            "a": pa.array([*none, *[x for x, _ in joined]], pa.int64()),
            "b": pa.array([*none, *[x for _, x in joined]], pa.int64()),
        })

    found = tables.save(full.groupBy("filter", "low", "high").applyInArrow(compare, "node long, gained long, a long, b long"), "blocks")
    gains = links.select(F.col("a").alias("node"), F.col("cb").alias("gained")).unionByName(links.select(F.col("b").alias("node"), F.col("ca").alias("gained")))
    gains = gains.unionByName(found.where("node IS NOT NULL").select("node", "gained"))
    counts = gains.groupBy("node").agg(F.sum("gained").alias("gained"))
    labels = components(links.select("a", "b").unionByName(found.where("a IS NOT NULL").select("a", "b")).where("a <> b"), tables)
    ids = classes.select("high", "low", "node", "copies").join(counts, "node", "left").join(labels, "node", "left")
    ids = ids.select("high", "low", (F.coalesce("gained", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "node").alias("root"))
    out = rows.select("vec_id", "high", "low", (F.col("unit").isNotNull() & F.col("vec_id").isNotNull()).alias("ok")).join(ids, ["high", "low"], "left")
    component = F.when(F.col("ok"), F.coalesce("root", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("ok"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
