"""Repeated passages by a compressed FM-index per shard (operator 13).

A window is WINDOW consecutive words. Texts are cut into segments: runs of
windows that share their least GRAM-word hash, the key. Equal windows have
equal keys, so a shard that gets all segments of its keys can answer for all
their windows, and each window is looked up in one shard only. Of equal
segments the earliest is indexed; all windows of the others start earlier
there. Keys whose segments are all one need no index, as nothing else can
match; a filter of fixed size tells which keys occur once, and what it lets
through needlessly does no harm.

A shard's index is the Burrows-Wheeler transform of its segments' words, as
bit vectors of a wavelet tree with counts each 64 bits, and the number of
smaller words; the order of suffixes isn't kept. Segments are streamed against
it: a backward search over the WINDOW words of a window narrows an interval of
the sorted suffixes, and is left as soon as one place is left (the matching
statistic stays below the threshold). Windows that end with the same interval
are equal, and all but the earliest are reported.

Suffixes are sorted by their first 32 words: for patterns of up to that length
the bounds of intervals are the same as in the full order. A key with more than
HOT segments is not put in one shard: its windows are compared by 128-bit
hashes, in aggregations and joins.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WorkTables, gathered, hash_filter, in_filter, mix64, odd_constants, releasing, sealed, split_words, word_hashes

WINDOW, GRAM = 20, 5
#: Windows of a segment at most; longer runs of one key are cut.
LONGEST = 64
#: Words of a shard, about; segments of a key that one shard may hold.
SHARD_WORDS, HOT = 1 << 17, 2000
BASE = 0x9E3779B97F4A7C1B
INVERSE = pow(BASE, -1, 1 << 64)
#: A position in the order of documents; null ids come last.
POSITION = "struct(doc_id is null as none, doc_id, start)"


def sliding(values: np.ndarray, width: int, pick=np.minimum) -> np.ndarray:
    """The least (or most) of every `width` consecutive values, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = pick(values[:-step], values[step:])
        done += step
    return values


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


def segments(hashes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, first word in all words, windows, key, content hash, several) of the segments of texts laid end to end.

    several: the key is met more than once, so that windows of the segment may be equal.
    """
    ends = np.cumsum(lengths)
    none = np.zeros(0, np.int64)
    if not len(hashes) or lengths.max() < WINDOW:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.astype(bool)
    count = len(hashes) - GRAM + 1
    grams = np.zeros(count, np.uint64)
    for k, factor in enumerate(odd_constants(5, GRAM)):
        grams += hashes[k : k + count] * factor
    grams = mix64(grams)
    span = WINDOW - GRAM + 1
    least = sliding(grams, span)
    # windows that lie in one text; at least WINDOW - 1 places that don't part two texts
    whole = np.flatnonzero(lengths >= WINDOW)
    edge = np.zeros(len(least) + 1, np.int8)
    edge[ends[whole] - lengths[whole]] += 1
    edge[ends[whole] - WINDOW + 1] -= 1
    inside = np.cumsum(edge[:-1], dtype=np.int8) > 0
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    text = np.searchsorted(ends, first, side="right")
    windows = np.minimum(np.append(first[1:], len(least)), ends[text] - WINDOW + 1) - first
    parts = -(-windows // LONGEST)
    if (parts > 1).any():
        place = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        text, first, windows = np.repeat(text, parts), np.repeat(first, parts) + place * LONGEST, np.minimum(np.repeat(windows, parts) - place * LONGEST, LONGEST)
    key = least[first]
    # places of grams that are the least of a window, and those among them that repeat the one before
    padded = np.concatenate([np.zeros(span - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(span - 1, np.uint64)])
    chosen = np.flatnonzero(grams == sliding(padded, span, np.maximum)[: len(grams)])
    again = chosen[1:][(grams[chosen[1:]] == grams[chosen[:-1]]) & (np.diff(chosen) <= span)]
    several = np.searchsorted(again, first + windows + span - 1) > np.searchsorted(again, first, side="right")
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(BASE, len(hashes)), dtype=np.uint64)])
    size = windows + WINDOW - 1
    content = mix64((sums[first + size] - sums[first]) * powers(INVERSE, len(hashes))[first] + size.astype(np.uint64))
    return text, first, windows, key, content, several


def _split(batch: pa.RecordBatch):
    words = [split_words(t) for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
    lengths = np.asarray([len(w) for w in words], np.int64)
    known = word_hashes()
    return np.concatenate([known.array(w) for w in words]), lengths


def _keys(batches):
    for batch in gathered(batches):
        _, _, _, key, content, several = segments(*_split(batch))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(several)], names=["key", "content", "several"])


def _repeated(twice: np.ndarray, mixed: np.ndarray):
    """Segments whose key occurs twice or more, with their words' hashes where the key has several segments."""

    def run(batches):
        for batch in gathered(batches):
            hashes, lengths = _split(batch)
            text, first, windows, key, content, several = segments(hashes, lengths)
            at = np.flatnonzero(in_filter(twice, key) | several)
            begin = np.cumsum(lengths) - lengths
            raw = hashes.tobytes()
            for low in range(0, len(at), 1 << 16):
                k = at[low : low + (1 << 16)]
                shown = in_filter(mixed, key[k]) | several[k]
                words = [raw[8 * a : 8 * (a + n + WINDOW - 1)] if s else None for a, n, s in zip(first[k].tolist(), windows[k].tolist(), shown.tolist(), strict=True)]
                ids, prints = (batch.column(batch.schema.get_field_index(x)).take(pa.array(text[k])) for x in ("doc_id", "print"))
                columns = [pa.array(key[k].view(np.int64)), pa.array(content[k].view(np.int64)), ids, prints, pa.array((first[k] - begin[text[k]]).astype(np.int32)), pa.array(windows[k].astype(np.int32)), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "content", "doc_id", "print", "start", "windows", "words"])

    return run


class WaveletTree:
    """Counts of a symbol before a place, from one bit vector a level; symbols with a leading 0 go before those with a 1."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.ones, self.zeros = [], [], []
        start = np.zeros(size, np.int64)
        every = np.arange(size)
        for level in range(self.levels - 1, -1, -1):
            bit = ((symbols >> level) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(64 - len(bit) % 64, bool)), bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.ones.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]))
            self.zeros.append(int(len(bit) - bit.sum()))
            start = self._down(len(self.bits) - 1, (every >> level) & 1, start)
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        self.start = start

    def _down(self, k: int, bit: np.ndarray, place: np.ndarray) -> np.ndarray:
        word = place >> 6
        low = (np.uint64(1) << (place & 63).astype(np.uint64)) - np.uint64(1)
        ones = self.ones[k][word] + np.bitwise_count(self.bits[k][word] & low)
        return np.where(bit, self.zeros[k] + ones, place - ones)

    def count(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        for k in range(self.levels):
            place = self._down(k, (symbol >> (self.levels - 1 - k)) & 1, place)
        return place - self.start[symbol]


class FMIndex:
    """Backward search over texts of symbols from 1; 0 ends each text."""

    def __init__(self, symbols: np.ndarray, size: int):
        rank = symbols
        for step in (1, 2, 4, 8, 16):
            ahead = np.append(rank[step:], np.zeros(min(step, len(rank)), rank.dtype))
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
        order = np.argsort(rank, kind="stable")
        self.length = len(symbols)
        self.smaller = np.append(0, np.cumsum(np.bincount(symbols, minlength=size)))
        self.tree = WaveletTree(symbols[order - 1], size)

    def intervals(self, symbols: np.ndarray, first: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
        """Windows (places in `first`) that occur twice or more, and the lower ends of their intervals."""
        at, low, high = np.arange(len(first)), np.zeros(len(first), np.int64), np.full(len(first), self.length)
        for k in range(length - 1, -1, -1):
            symbol = symbols[first[at] + k]
            both = self.smaller[symbol] + self.tree.count(np.tile(symbol, 2), np.concatenate([low, high])).reshape(2, -1)
            stay = both[1] - both[0] > 1
            at, low, high = at[stay], both[0][stay], both[1][stay]
        return at, low


def repeats(positions: list[np.ndarray], windows: np.ndarray, words: list[np.ndarray]) -> list[np.ndarray]:
    """Per segment the windows (0, 1, ...) that also start earlier in these segments. positions: (none, doc_id, start) of the segments."""
    sizes = np.asarray([len(w) for w in words])
    known, ids = np.unique(np.concatenate(words), return_inverse=True)
    text = np.insert(ids.astype(np.int64) + 1, np.cumsum(sizes), 0)  # a 0 after each segment
    begin = np.cumsum(sizes + 1) - sizes - 1
    owner = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    index = FMIndex(text, len(known) + 1)
    at, low = index.intervals(text, begin[owner] + place)
    none, doc, start = (x[owner[at]] for x in positions)
    start = start + place[at]
    order = np.lexsort((start, doc, none, low))
    changed = lambda *xs: np.append(True, np.any([x[order][1:] != x[order][:-1] for x in xs], axis=0)) if len(order) else np.zeros(0, bool)
    group, spot = np.cumsum(changed(low)) - 1, np.cumsum(changed(low, none, doc, start))
    head = spot[np.flatnonzero(changed(low))] if len(order) else spot
    later = at[order[spot > head[group]]] if len(order) else at
    flagged = np.zeros(len(owner), bool)
    flagged[later] = True
    return np.split(place[flagged], np.cumsum(np.bincount(owner[flagged], minlength=len(windows)))[:-1])


def _indexed(part: pa.Table) -> pa.Table:
    get = lambda name: part.column(name).combine_chunks()
    words = [np.frombuffer(x.as_buffer(), np.uint64) for x in get("words")]
    positions = [get("none").to_numpy(zero_copy_only=False), get("doc_id").fill_null(0).to_numpy(), get("start").to_numpy().astype(np.int64)]
    found = repeats(positions, get("windows").to_numpy().astype(np.int64), words)
    kept = [k for k, x in enumerate(found) if len(x)]
    return pa.table({"key": get("key").take(pa.array(kept, pa.int64())), "content": get("content").take(pa.array(kept, pa.int64())), "places": pa.array([found[k].tolist() for k in kept], pa.list_(pa.int32()))})


def _window_prints(batches):
    """A row for each window of a segment: its place and two hashes of its words."""
    for batch in batches:
        get = lambda name: batch.column(batch.schema.get_field_index(name))
        for k, raw in enumerate(get("words")):
            data = memoryview(raw.as_buffer())
            n = len(data) // 8 - WINDOW + 1
            prints = [xxhash.xxh3_128_digest(data[8 * p : 8 * (p + WINDOW)]) for p in range(n)]
            one, two = np.frombuffer(b"".join(prints), np.int64).reshape(-1, 2).T
            same = [get(x).take(pa.array(np.full(n, k))) for x in ("key", "content", "none", "doc_id", "start")]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.arange(n, dtype=np.int32)), pa.array(one.copy()), pa.array(two.copy())], names=["key", "content", "none", "doc_id", "start", "place", "one", "two"])


def _print() -> Column:
    return F.xxhash64(F.col("text").cast("binary"))


def _lean(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _print().alias("print"), F.col("text").cast("binary").alias("text"))


def repeated_spans(docs: DataFrame, tables: WorkTables) -> DataFrame:
    """(doc_id, print, spans): the words (low to high, high excluded) of each text that repeated windows cover; spans may overlap.

    print is xxhash64 of the text, as rows may share a doc_id. Rows of one
    doc_id have the same positions, of which none is earlier.
    """
    lean = _lean(docs)
    seen = lean.mapInArrow(releasing(_keys), "key long, content long, several boolean").groupBy("key")
    seen = seen.agg(F.count(F.lit(1)).alias("n"), F.min("content").alias("c0"), F.max("content").alias("c1"), F.max("several").alias("several"))
    keys = tables.save(seen.where("n > 1").select("key", (F.col("several") | (F.col("c0") != F.col("c1"))).alias("mixed")), "keys")
    twice, mixed = hash_filter(keys.select("key")), hash_filter(keys.where("mixed").select("key"))
    schema = "key long, content long, doc_id long, print long, start int, windows int, words binary"
    found = tables.save(lean.mapInArrow(releasing(_repeated(twice, mixed)), schema), "segments")

    position = F.expr(POSITION)
    firsts = tables.save(found.groupBy("key", "content").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("copies")), "firsts")
    shown = found.where("words IS NOT NULL").groupBy("key", "content").agg(F.min(position).alias("p"), F.first("windows").alias("windows"), F.first("words").alias("words"))
    shown = tables.save(shown.select("key", "content", "p.none", "p.doc_id", "p.start", "windows", "words"), "shown")
    by_key = shown.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = tables.save(by_key.where(F.col("n") > HOT).select("key"), "hot")
    total = shown.agg(F.sum(F.octet_length("words") / 8)).first()[0] or 0
    shards = int(total // SHARD_WORDS) + 1
    cold = shown.join(hot, "key", "left_anti").withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    places = cold.groupBy("shard").applyInArrow(_indexed, "key long, content long, places array<int>")
    prints = tables.save(shown.join(hot, "key", "left_semi").mapInArrow(_window_prints, "key long, content long, none boolean, doc_id long, start int, place int, one long, two long"), "windows")
    at = F.expr("struct(none, doc_id, start + place as start)")
    earliest = prints.groupBy("one", "two").agg(F.min(at).alias("earliest"))
    later = prints.join(earliest, ["one", "two"]).where(at > F.col("earliest")).groupBy("key", "content").agg(F.sort_array(F.collect_list("place")).alias("places"))  # LONGEST at most
    places = tables.save(places.unionByName(later), "places")

    told = firsts.where("copies > 1").join(places, ["key", "content"], "full")
    mine = found.select("key", "content", "doc_id", "print", "start", "windows").join(told, ["key", "content"])
    whole = F.array(F.struct(F.col("start").alias("low"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("high")))
    some = F.transform("places", lambda p: F.struct((F.col("start") + p).alias("low"), (F.col("start") + p + WINDOW).alias("high")))
    spans = F.when(position > F.col("first"), whole).otherwise(some)
    listed = tables.save(mine.select("doc_id", "print", spans.alias("spans")).where("spans IS NOT NULL"), "spans")
    return listed.groupBy("doc_id", "print").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def _kept(text: bool):
    """Per row the number of words, of removed words, the checksum of the kept ones; and the kept text, if asked for."""

    def run(batches):
        for batch in gathered(batches):
            get = lambda name: batch.column(batch.schema.get_field_index(name))
            out = [[], [], [], []]
            for raw, spans in zip(get("text").to_pylist(), get("spans"), strict=True):
                words = split_words(raw)
                n, removed = len(words), 0
                if spans.is_valid and len(spans.values):
                    low, high = (spans.values.field(x).to_numpy() for x in ("low", "high"))
                    depth = np.bincount(low, minlength=n + 1) - np.bincount(high, minlength=n + 1)
                    stay = np.cumsum(depth[:n]) == 0
                    removed = n - int(stay.sum())
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                joined = b" ".join(words)
                for column, value in zip(out, (n, removed, hashlib.sha256(joined).hexdigest(), raw if not removed else joined), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            columns = [pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
            rest = [x for x in batch.schema.names if x not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([*map(get, rest), *columns[:3], *([columns[3].cast(pa.string())] if text else [])], names=[*rest, "__words", "__removed", "__sha256", *(["text"] if text else [])])

    return run


def _with_spans(rows: DataFrame, tables: WorkTables) -> DataFrame:
    """rows (with doc_id, print, text) and the spans of their texts."""
    spans = repeated_spans(rows, tables).withColumnsRenamed({"doc_id": "__id", "print": "__print"})
    return rows.join(spans, rows["doc_id"].eqNullSafe(spans["__id"]) & (rows["print"] == spans["__print"]), "left").drop("__id", "__print")


def repeat_digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256.

    Each word goes that a window covers whose word sequence also starts
    earlier: in a smaller doc_id, or in the same at an earlier word. A null
    doc_id comes after all others. Rows that share a doc_id count as one
    place: none of them is earlier for its row. Null texts have no words; texts
    of any length count whole; shorter ones than a window stay. Other columns
    are not read. An empty table gives no rows.
    """
    tables = WorkTables(docs.sparkSession, "substrings")
    joined = _with_spans(_lean(docs), tables).select("doc_id", "text", "spans")
    found = joined.mapInArrow(releasing(_kept(False)), "doc_id long, __words long, __removed long, __sha256 string")
    return found.toDF("doc_id", "n_words", "n_removed", "kept_sha256")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """docs without the words that repeat_digest removes; a text that loses some has its kept words joined by one space.

    All columns stay, whatever their names, and all rows; others' texts are unchanged.
    """
    tables = WorkTables(docs.sparkSession, "substrings")

    def run(rows: DataFrame) -> DataFrame:
        named = rows.withColumns({"__key": F.col("doc_id"), "doc_id": F.col("doc_id").cast("long"), "print": _print()})
        joined = _with_spans(named, tables).withColumn("text", F.col("text").cast("binary"))
        kinds = {f.name: f.dataType.simpleString() for f in joined.schema}
        rest = [c for c in joined.columns if c not in ("text", "spans")]
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "__words long, __removed long, __sha256 string, text string"])
        return joined.mapInArrow(releasing(_kept(True)), schema).withColumn("doc_id", F.col("__key"))

    return sealed(docs, ("doc_id", "text"), run)


SQL = """
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(len(w) - 19)) AS start, unnest(list_transform(range(len(w) - 19), lambda i: array_to_string(w[i + 1:i + 20], ' '))) AS said
  FROM words WHERE len(w) >= 20
), later AS (
  SELECT doc_id, start FROM windows QUALIFY row_number() OVER (PARTITION BY said ORDER BY doc_id, start) > 1
), listed AS (SELECT doc_id, unnest(range(len(w))) AS pos, unnest(w) AS word FROM words),
marked AS (
  SELECT listed.doc_id, pos, word, max(start) OVER (PARTITION BY listed.doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
  FROM listed LEFT JOIN later ON later.doc_id = listed.doc_id AND later.start = pos
), summed AS (SELECT doc_id, count_if(gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS kept FROM marked GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN summed USING (doc_id)
"""
