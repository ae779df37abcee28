"""Near-duplicates by fast similarity sketching, banding and exact checks (operator 9).

A document is the set of its distinct five-word shingles. Its sketch has T
bins. In round i < T every shingle is hashed to a bin and a value in
[i, i + 1); in round i >= T every shingle competes for bin i - T; a bin keeps
the smallest value it saw. Rounds stop as soon as every bin is filled, so long
documents need one round and a sketch still fills whatever the size. Two
sketches agree in a bin with probability equal to the sets' Jaccard index.

Bins are taken in BANDS groups of ROWS; documents that agree in a whole group
are candidates. Candidates are confirmed on full shingle sets. Documents with
equal sets are one class from the start, and only classes are compared.

No pairs of a large bucket are listed. First every class is compared with the
smallest class among its buckets; links give components, and only buckets that
still hold several components go on. Buckets of up to SMALL members list their
pairs across components. In larger ones, members outside a random leader's
component are compared with that leader, ROUNDS times; what is still open is
compared exhaustively across components, in blocks of two chunks of members
whose sets meet in one task, which returns links only. A block looks at a pair
in the first bucket that it shares and reads the full sets, unless the two are
joined by then: links inside one component cannot change the result. Chunks
are bounded by rows and by the bytes of their sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import WordHashes, WorkTables, mix64, odd_constants, pieces, releasing, sealed, split_words, windows_hash, word_hashes
from .components import components

SHINGLE = 5
#: Bins per band and bands: a pair at Jaccard 0.8 is missed with probability (1 - 0.8^6)^40, about 5e-6.
ROWS, BANDS = 6, 40
BINS = ROWS * BANDS
#: Members of a bucket whose pairs are listed, rounds with a random leader, and members of a chunk of a larger bucket.
SMALL, ROUNDS, CHUNK, CHUNK_BYTES = 12, 2, 256, 16 << 20
#: Pairs in an Arrow batch, as each carries both full sets.
PAIRS = 64
#: Pairs of one leader that one task may hold.
LEADER_PAIRS = 256


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a shorter text is one shingle as a whole, no words give none."""
    if 0 < len(words) < n:
        return windows_hash(words, len(words), seed=len(words))
    return np.unique(windows_hash(words, n))


def sketches(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """One row of bins per set; the round in the upper 16 bits. Empty sets keep the largest value."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(len(sets) * bins, none, dtype=np.uint64)
    sizes = np.asarray([len(s) for s in sets])
    todo = np.flatnonzero(sizes)
    if len(todo):
        items = np.concatenate([sets[k] for k in todo])
        owner = np.repeat(todo, sizes[todo])
    seeds = mix64(np.arange(1, 2 * bins + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    for i in range(2 * bins):
        if not len(todo):
            break
        hashed = mix64(items ^ seeds[i])
        place = (hashed >> np.uint64(48)) % np.uint64(bins) if i < bins else np.uint64(i - bins)
        value = (np.uint64(i) << np.uint64(48)) | (hashed & np.uint64(0xFFFFFFFFFFFF))
        np.minimum.at(out, (owner * bins + place.astype(np.int64)) if i < bins else owner * bins + (i - bins), value)
        full = (out.reshape(-1, bins)[todo] != none).all(axis=1)
        if full.any():
            ended = np.zeros(len(sets), dtype=bool)
            ended[todo[full]] = True
            todo = todo[~full]
            stay = ~ended[owner]
            items, owner = items[stay], owner[stay]
    return out.reshape(-1, bins)


def band_keys(table: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band; equal only where all bins of the band are, and for the same band."""
    bands = table.shape[1] // rows
    parts = mix64(table.reshape(len(table), bands, rows)) * odd_constants(7, rows)
    return mix64(parts.sum(axis=2, dtype=np.uint64) + odd_constants(11, bands))


def _sets_of(batch: pa.RecordBatch, hashes: WordHashes) -> list[np.ndarray]:
    texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
    return [shingle_set(hashes.array(split_words(t.lower() if t else None))) for t in texts]


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for two non-empty sorted sets."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < percent * large:
        return False
    same = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * same >= percent * (small + large - same)


def block_links(percent: int, band: int, nodes, roots, chunks, tables, sets) -> list[tuple[int, int]]:
    """Links across components between two chunks (or within one) of a bucket; enough of them to join what is linked."""
    one = chunks == chunks.min()
    left, right = np.flatnonzero(one), np.flatnonzero(~one) if not one.all() else np.flatnonzero(one)
    tried = []
    for k in left:
        same = tables[k] == tables[right]
        count = same.sum(axis=1)
        first = same.reshape(len(right), BANDS, ROWS).all(axis=2).argmax(axis=1)
        fit = (first == band) & (roots[k] != roots[right]) & ((nodes[k] < nodes[right]) | (chunks[k] != chunks[right]))
        tried += [(-int(count[x]), int(k), int(right[x])) for x in np.flatnonzero(fit)]
    top = {r: r for r in roots.tolist()}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    out = []
    for _, k, x in sorted(tried):
        a, b = find(int(roots[k])), find(int(roots[x]))
        if a != b and alike(np.frombuffer(sets[k], np.uint64), np.frombuffer(sets[x], np.uint64), percent):
            top[max(a, b)] = min(a, b)
            out.append((int(nodes[k]), int(nodes[x])))
    return out


def _features(batches):
    hashes = word_hashes()
    for batch in pieces(batches):
        sets = _sets_of(batch, hashes)
        keys = band_keys(sketches(sets)).view(np.int64)
        sizes = [len(s) for s in sets]
        ids = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        high, low = np.frombuffer(b"".join(ids), dtype=">i8").astype(np.int64).reshape(-1, 2).T
        bands = [k if n else None for k, n in zip(keys, sizes, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int64()), pa.array(high), pa.array(low), pa.array(bands, pa.list_(pa.int64()))],
            names=["doc_id", "n_shingles", "high", "low", "bands"],
        )


def _full_sets(batches):
    hashes = word_hashes()
    for batch in pieces(batches):
        sets = _sets_of(batch, hashes)
        low = sketches(sets).astype(np.uint32)
        columns = [batch.column(batch.schema.get_field_index("doc_id")), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([row.tobytes() for row in low], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "items", "sketch"])


def _lean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (leader, node) with 100 * intersection >= percent * union.

    A leader's set is dealt to as many keys as its pairs need, so that a
    leader of very many pairs is not one task's work.
    """

    def check(batches):
        for batch in batches:
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            hit, last, mine = [], None, None
            for x, y in zip(get("left"), get("right"), strict=True):
                a = x.as_buffer()
                if last is None or not a.equals(last):
                    last, mine = a, np.frombuffer(a, np.uint64)
                hit.append(alike(mine, np.frombuffer(y.as_buffer(), np.uint64), percent))
            kept = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([get("leader"), get("node")], names=["a", "b"]).filter(kept)

    deals = pairs.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / LEADER_PAIRS).cast("int").alias("deals"))
    leaders = sets.join(deals, sets["node"] == deals["leader"]).select("leader", F.col("items").alias("left"), "deals", F.explode(F.expr("sequence(0, deals - 1)")).alias("deal"))
    dealt = pairs.join(deals, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), F.col("deals")).cast("int").alias("deal"))
    ready = dealt.join(sets.withColumnRenamed("items", "right"), "node").join(leaders.drop("deals"), ["leader", "deal"])
    return ready.select("leader", "node", "left", "right").mapInArrow(releasing(check), "a long, b long")


def _blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components within the buckets of rows (place, band, node, root, members, bytes)."""

    def compare(table: pa.Table) -> pa.Table:
        get = lambda name: table.column(name).combine_chunks()
        values = [get(x).to_numpy() for x in ("node", "root", "chunk")]
        low = np.stack([np.frombuffer(x.as_buffer(), np.uint32) for x in get("sketch")])
        found = block_links(percent, get("place")[0].as_py(), *values, low, [x.as_buffer() for x in get("items")])
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    chunks = F.ceil(F.greatest(F.col("members") / CHUNK, F.col("bytes") / CHUNK_BYTES)).cast("int")
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select("place", "band", "node", "root", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    return dealt.join(sets, "node").groupBy("band", "place", "low", "high").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Lower-cased (A-Z) words of whole texts, however long. Null text, and text
    without words, has no shingles and links with nothing. Sets at exactly
    `percent` link. Other columns of docs are not read. Rows that share a doc_id are one
    node. A null doc_id links with nothing: component_id is null and kept true.
    An empty table gives no rows.
    """
    tables = WorkTables(docs.sparkSession, "neardup")
    rows = tables.save(_lean(docs).mapInArrow(releasing(_features), "doc_id long, n_shingles long, high long, low long, bands array<long>"), "features")
    linkable = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = tables.save(linkable.groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.max(F.col("n_shingles") * 8).alias("size")), "classes")
    buckets = classes.select("node", "size", F.posexplode("bands").alias("place", "band"))
    shared = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("top")).where("leader <> top").select("band", "leader")
    members = tables.save(buckets.join(shared, "band").select("place", "band", "node", "size", "leader"), "members")

    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = _lean(docs).join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text")
    sets = tables.save(texts.mapInArrow(releasing(_full_sets), "node long, items binary, sketch binary"), "sets")
    sets = sets.dropDuplicates(["node", "items"]) if not rows.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty() else sets

    items = sets.select("node", "items")
    first = members.where("node <> leader").groupBy("node").agg(F.min("leader").alias("leader"))
    links = tables.save(_confirm(first, items, percent), "links", batch=PAIRS)
    labels = components(links, tables)
    members = members.drop("leader")
    for step in range(ROUNDS + 1):
        placed = members.join(labels, "node", "left").select("place", "band", "node", "size", F.coalesce("root", "node").alias("root"))
        still = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count(F.lit(1)).alias("members"), F.sum("size").alias("bytes")).where("r0 <> r1").select("band", "members", "bytes")
        opened = tables.save(placed.join(still, "band"), "open")
        large = opened.where(F.col("members") > SMALL)
        if step < ROUNDS:
            h = F.struct(F.xxhash64("node", F.lit(step)).alias("h"), F.col("node").alias("leader"), F.col("root").alias("lead_root"))
            lead = large.groupBy("band").agg(F.min(h).alias("x")).select("band", "x.leader", "x.lead_root")
            pairs = large.join(lead, "band").where("root <> lead_root").select("leader", "node")
            if step == 0:
                small = opened.where(F.col("members") <= SMALL)
                other = small.select("band", F.col("node").alias("leader"), F.col("root").alias("lead_root"))
                pairs = pairs.unionByName(small.join(other, "band").where("root <> lead_root AND leader < node").select("leader", "node"))
            found = tables.save(_confirm(tables.save(pairs.distinct(), "pairs"), items, percent), "links", batch=PAIRS)
        else:
            found = tables.save(_blocks(large, sets, percent), "links")
        if not found.isEmpty():
            links = tables.save(links.unionByName(found), "links")
            labels = components(links, tables)
        members = large.select("place", "band", "node", "size")

    ids = classes.select("high", "low", "node").join(labels, "node", "left").select("high", "low", F.coalesce("root", "node").alias("root"))
    out = rows.select("doc_id", "n_shingles", "high", "low").join(ids, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id, once."""
    found = near_duplicates(docs.select("doc_id", "text"), percent)
    kept = found.where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()

    def keep(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("__id", F.col("doc_id").cast("long"))
        matched = named.join(kept.hint("shuffle_hash"), "__id", "left_semi")
        once = matched.withColumn("__n", F.row_number().over(W.partitionBy("__id").orderBy(F.xxhash64("text"), F.lit(0)))).where("__n = 1")
        return once.drop("__n").unionByName(named.where("__id IS NULL"))

    return sealed(docs, ("doc_id", "text"), keep)
