"""Operators on documents against brute force, and on awkward rows."""

import collections
import itertools
import math
import pickle
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strideframe.llm import linedup, lmscore, mixing, neardup, packing, quality, sharding, tokenfile, tokens

public = pytest.importorskip("public_tokenizers")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_chars long, size string, copies string, __id string"


def table(spark, rows):
    """rows (doc_id, text, source); the further columns clash with names that operators use."""
    return spark.createDataFrame([(i, t, s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], SCHEMA)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    rows = [(i, say(rng.randint(5, 120)), f"s{rng.choice([0, 0, 0, 1, 2])}") for i in range(n)]
    base = say(60).split()
    for k in range(15):  # near copies of one text
        words = list(base)
        words[rng.randrange(60)] = f"edit{k}"
        rows.append((n + k, " ".join(words), "s1"))
    rows += [(n + 20 + k, rows[0][1], "s0") for k in range(10)]  # exact copies
    return rows


ODD = [(None, "no id at all here but ten words in this text", "s0"), (500, None, None), (501, "", "s1"), (502, "  \n\t ", "s9"), (503, "one", "s9"), (504, "Ünï cödé ÄÖ " * 400, "s2"), (505, "tie tie", "s2"), (505, "tie tie", "s2"), (506, "a\x1fb c", None)]


@pytest.fixture(scope="module")
def rows():
    return corpus() + ODD


def words_of(text):
    return WORDS.findall(text or "")


def test_mixing(spark, rows):
    found = mixing.mixing_digest(table(spark, rows)).collect()
    assert len(found) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    by_id = {i: (s, len(words_of(t))) for i, t, s in rows}
    taken = collections.Counter()
    for r in found:
        s, size = by_id[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size, sizes[s]) and r["target"] == pytest.approx(target[s])
        assert r["taken"] in (0, size, 2 * size)
        taken[s] += r["taken"]
    for s in order:
        assert abs(taken[s] - target[s]) <= 2 * max((len(words_of(t)) for _, t, x in rows if x == s), default=0)
    again = mixing.mixing_digest(table(spark, rows).repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))


def test_mix_emits_rows(spark, rows):
    docs = table(spark, rows)
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns
    words = sum(len(words_of(r["text"])) for r in mixed.collect())
    assert words == sum(r["taken"] for r in mixing.mixing_digest(docs).collect())


def test_mixing_spreads_rows_without_ids_and_keeps_other_columns(spark):
    docs = spark.createDataFrame([(None, f"some words number {k}", "s0", 9, "mine") for k in range(200)], "doc_id long, text string, source string, size int, __src string")
    found = mixing.mixed(docs)
    assert found.columns == ["doc_id", "text", "source", "__src", "size", "source_size", "target", "copies"]
    rows = found.collect()
    assert {(r["__src"], r["size"], r["source_size"]) for r in rows} == {("mine", 4, 800)} and abs(sum(4 * r["copies"] for r in rows) - rows[0]["target"]) <= 4
    assert sorted(map(str, mixing.mixed(docs.repartition(5)).collect())) == sorted(map(str, rows))


def test_sharding(spark, rows):
    found = sharding.shard_digest(table(spark, rows), shards=16).collect()
    by_shard = collections.defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["slot"])
    assert len(found) == len(rows) and max(map(len, by_shard.values())) - min(map(len, by_shard.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by_shard.values())
    text = {i: t for i, t, _ in rows}
    for r in found:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    again = sharding.shard_digest(table(spark, rows).repartition(5), shards=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, found))
    assert sharding.shard(table(spark, rows)).select("doc_id", "shard", "slot").distinct().count() >= len(rows) - 1


def test_shards_equal_the_formula(spark, rows):
    """Row numbers in the order of (id, checksum, size), permuted one by one."""
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    place = [int(sharding.feistel(np.array([k]), len(rows))[0]) for k in range(len(rows))]
    want = collections.Counter((i, zlib.crc32((t or "").encode()), p % 16, p // 16) for (i, t, _), p in zip(order, place, strict=True))
    assert collections.Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in sharding.shard_digest(table(spark, rows)).collect()) == want
    odd = table(spark, rows).withColumnsRenamed({"source": "slot", "size": "column_3", "copies": "__row"})
    whole = sharding.shard(odd)
    assert whole.columns == ["doc_id", "text", "n_chars", "column_3", "__row", "__id", "shard", "slot"]
    assert collections.Counter((r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in whole.collect()) == want


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(sharding.feistel(np.arange(n), n, seed=5)) == list(range(n))
    if n > 100:
        assert (sharding.feistel(np.arange(n), n) != np.arange(n)).mean() > 0.9


def test_quality_base(spark, rows):
    more = [(600, "x y z a b " * 3 + "c d e f", "s0"), (601, "#tag $5 a|b <i>\nline\nline\n\nline", "s0")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(None, 0, None)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.quality_digest(table(spark, rows + more), labels).collect()}
    for i, t, _ in rows + more:
        w = words_of(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeated = {k + j for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
        r = found[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(repeated))
        failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_quality_verdict(spark):
    rng = random.Random(2)
    good, bad = [f"word{k}" for k in range(200)], [f"junk{k}" for k in range(200)]
    text = lambda v: " ".join(rng.choice(v) for _ in range(50))
    rows = [(i, text(good if i % 3 else bad), "s") for i in range(300)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    found = quality.quality_digest(docs, labels).collect()
    assert all(r["kept"] == bool(r["doc_id"] % 3) for r in found if not r["base_failed"])
    kept = quality.keep_quality(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in found if r["kept"]}
    assert quality.quality_digest(docs, labels.limit(0)).where("NOT kept AND NOT base_failed").count() == 0


def test_quality_equals_brute_force(spark):
    """Scores and verdicts, recounted without hashing into arrays: one plain sum per document."""
    rng = random.Random(3)
    good, bad, both = ([f"{x}{k}" for k in range(150)] for x in ("good", "bad", "all"))
    docs = [(k, " ".join(rng.choice(both if rng.random() < 0.5 else good if k % 3 else bad) for _ in range(rng.choice((12, 40, 300)))), "s") for k in range(240)]
    docs += [(None, docs[1][1], "s"), (300, docs[2][1], "s"), (300, docs[2][1], "s"), (301, None, "s"), (302, "", "s"), (303, " ".join(good) * 400, "s")]
    labels = [(k, int(bool(k % 3)), 0) for k in range(0, 240, 2)]
    model = quality.fit_quality(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    order = quality.labelled(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), 1)
    hashes = quality.word_hashes()
    marks = lambda t: quality.features(hashes.array((t or "").encode().split())).tolist()
    total, target = collections.Counter(), collections.Counter()
    for i, t, _ in docs:
        total.update(marks(t))
        target.update(marks(t) if i in order[::2] else [])
    n, m, b = sum(total.values()), sum(target.values()), quality.BUCKETS
    weight = lambda k: math.log((target[k] + 1) / (m + b)) - math.log((total[k] + 1) / (n + b))
    score = lambda t: sum(map(weight, marks(t))) / len(marks(t)) if marks(t) else 0.0
    found = quality.quality_digest(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(found) == len(docs)
    text, failed = {i: t for i, t, _ in docs}, {r["doc_id"]: r["base_failed"] for r in found}
    kept = sorted(score(text[i]) for i in order[1::2] if not failed[i])
    below = sorted(x for i, q, _ in labels if not q and not failed[i] and (x := score(text[i])) < kept[0])
    edge = (kept[0] + below[int(0.99 * (len(below) - 1))]) / 2 if below else kept[0]
    assert model.edge == pytest.approx(edge)
    for r in found:
        want = score(text[r["doc_id"]])
        assert r["score"] == pytest.approx(want) and r["kept"] == (not r["base_failed"] and want >= edge)


def test_quality_uses_all_labels(spark):
    """More trusted rows than were once sampled: each counts in its half, and the threshold is the exact quantile of the other."""
    n = 44_000
    text = F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(k)), F.lit(3000 if k else 9))) for k in range(12)])
    docs = spark.range(n, numPartitions=4).select(F.col("id").alias("doc_id"), text.alias("text")).cache()
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 50 != 0).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    model = quality.fit_quality(docs, labels.union(labels))
    order = quality.labelled(labels, 1)
    assert sorted(order) == [k for k in range(n) if k % 50]
    hashes = quality.word_hashes()
    marks = {r["doc_id"]: quality.features(hashes.array(r["text"].encode().split())) for r in docs.collect()}
    docs.unpersist()
    total, target = (np.bincount(np.concatenate([marks[k] for k in ids]), minlength=quality.BUCKETS) for ids in (range(n), order[::2]))
    weights = np.log((target + 1) / (target.sum() + quality.BUCKETS)) - np.log((total + 1) / (total.sum() + quality.BUCKETS))
    assert np.allclose(model.weights, weights)
    kept = np.quantile([weights[marks[k]].mean() for k in order[1::2]], quality.LOSS, method="lower")
    below = [x for k in range(0, n, 50) if (x := weights[marks[k]].mean()) < kept]
    assert model.edge == pytest.approx((kept + np.quantile(below, 0.99, method="lower")) / 2 if below else kept)


def test_quality_quantiles_are_exact(spark):
    rng = np.random.default_rng(5)
    for values in (rng.normal(size=5000), np.round(rng.normal(size=3000), 1), np.r_[np.full(900, 1e-300), -1e9, 1.0, 1e9], [0.25]):
        scores = spark.createDataFrame([(float(x),) for x in values], "score double").cache()
        for share in (0.0, 0.001, 0.5, 0.99, 1.0):
            assert quality.quantile(scores, share) == np.quantile(values, share, method="lower")
    assert quality.quantile(scores.limit(0), 0.5) is None


def test_lm_words_at_once(monkeypatch):
    """Words, counts and symbols of many texts at a time against plain splitting: odd spaces, bytes that are no UTF-8, null, sliced batches, flushes."""
    rng = random.Random(7)
    odd = [b"", None, b" ", b"\n\x0b\x0c A\tb\r\n", b"a\xa0B \xc2\xa0 \x1cC\x85 \xff\xfe X", "\u00c9T\u00c9 \u2003\u00dfx".encode(), b"Z" * 5000]
    texts = odd * 3 + [b" ".join(b"W%d" % rng.randrange(400) for _ in range(rng.randrange(60))) + b"\n" * rng.randrange(2) for _ in range(200)]
    docs = [None, *range(len(texts) - 1)]
    plain = lambda t: (t or b"").lower().split() + [b" "]
    batch = pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    words, sizes = lmscore.words_of(batch.slice(5))
    assert words.cast(pa.binary()).to_pylist() == [w for t in texts[5:] for w in plain(t)[:-1]] and sizes.tolist() == [len(plain(t)) - 1 for t in texts[5:]]
    some = [b"w1", b" ", b"x", b"\xff\xfe"]
    for listed in (some, some[:1], []):
        want = [listed.index(w) if w in listed else 9 for t in texts[5:] for w in plain(t)]
        assert lmscore.ranks_of(words, sizes, lmscore._listed(listed), 9).tolist() == want
    counts = collections.Counter(w for i, t in zip(docs, texts, strict=True) if lmscore.fold(i) != lmscore.HELD for w in plain(t))
    for flush in (10, 300, 400_000):
        monkeypatch.setattr(lmscore, "FLUSH", flush)
        found = collections.Counter()
        for out in lmscore._count(iter([batch.slice(0, 90), batch.slice(90)])):
            for w, n in zip(out.column("word").to_pylist(), out.column("n").to_pylist(), strict=True):
                found[w] += n
        assert found == counts
    assert list(lmscore._count(iter([batch.slice(0, 0)]))) == []
    dealt = next(lmscore._symbols(types.SimpleNamespace(value=pickle.dumps({"words": some})), 5, 3)(iter([batch])))
    training = [plain(t) for i, t in zip(docs, texts, strict=True) if lmscore.fold(i) != lmscore.HELD]
    assert [np.frombuffer(x, "<u2").tolist() for x in dealt.column("symbols").to_pylist()] == [[some.index(w) if w in some else 4 for w in t] for t in training]


def test_lanes_that_end_together():
    """Padded windows hand out each document whole and in order, in few windows."""
    rng = np.random.default_rng(3)
    sizes, counts = rng.integers(1, 90, 200).tolist() + [700], {}
    for pad in (False, True):
        lanes, seen, counts[pad] = lmscore.Lanes(lanes=16, steps=32), collections.defaultdict(list), 0
        for n in sizes:
            lanes.add(rng.integers(0, 9, n))
        want = {doc: x.tolist() for row in lanes.rows for doc, x in row}
        for _, ids, starts, docs in lanes.windows(True, pad):
            counts[pad] += 1
            for lane in range(ids.shape[1]):
                for i, start, doc in zip(ids[:, lane].tolist(), starts[:, lane].tolist(), docs[:, lane].tolist(), strict=True):
                    assert start == (doc >= 0 and not seen[doc])
                    seen[doc].append(i)
        assert {k: x for k, x in seen.items() if k >= 0} == want and (pad or -1 not in seen)
        assert not lanes.sizes.any()
    assert counts[True] < counts[False] - 5


def components(rows, percent):
    """Brute force over all pairs; rows of one doc_id are one node."""
    sets, top = collections.defaultdict(list), {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        sets[i].append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
        top[i] = i
    find = lambda x: x if top[x] == x else find(top[x])
    ids = [i for i in sets if i is not None]
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                top[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}, sets


@pytest.mark.parametrize(("percent", "small", "chunk"), [(85, 12, 256), (70, 1, 4)])
def test_near_duplicates(spark, rows, monkeypatch, percent, small, chunk):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "CHUNK", chunk)
    monkeypatch.setattr(neardup, "ROUNDS", 1 if small == 1 else 2)
    want, sets = components(rows, percent)
    found = neardup.near_duplicates(table(spark, rows), percent).collect()
    assert len(found) == len(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["component_id"] == r["doc_id"])
            assert r["n_shingles"] in [len(x) for x in sets[r["doc_id"]]]
    docs = table(spark, rows)
    left = neardup.drop_near_duplicates(docs, percent)
    assert left.columns == docs.columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({i for i, root in want.items() if i == root}) and ids.count(None) == 1


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(0)
    for size in (3, 40, 3000):
        pool = rng.integers(0, 2**63, 3 * size).astype(np.uint64)
        a, b = np.unique(pool[: 2 * size]), np.unique(pool[size:])
        table = neardup.sketches([a, b, np.zeros(0, np.uint64)], bins=600)
        assert (table[:2] != np.uint64(2**64 - 1)).all() and (table[2] == np.uint64(2**64 - 1)).all()
        assert abs((table[0] == table[1]).mean() - 1 / 3) < (0.35 if size == 3 else 0.08)


def test_packing(spark, rows):
    path = public.path("word_bpe_49k.json")
    found = packing.pack(table(spark, rows), path).collect()
    sequences, documents = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        documents[r["doc_id"]].append(r)
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    times = collections.Counter(i for i, _, _ in rows)
    for i, t, _ in rows:
        ids = np.asarray([*tool.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        got = sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in documents[i])
        want = [(s, n, zlib.crc32(ids[s : s + n].tobytes()), len(ids)) for s, n in packing.cuts(len(ids)) for _ in range(times[i])]
        assert got == sorted(want)


def test_column_generation_fills_sequences():
    rng = np.random.default_rng(3)
    lengths = np.arange(32, 2049, 32)
    demand = rng.integers(50, 400, len(lengths))
    plan = packing.plan_patterns(lengths, demand)
    assert (sum(x * p for x, p in plan) == demand).all() and all((p * lengths).sum() <= 2048 for _, p in plan)
    used = sum(x for x, _ in plan)
    least = max((lengths * demand).sum() / 2048, demand[lengths > 1024].sum())
    assert used <= 1.04 * least
    assert packing.plan_patterns(np.zeros(0, np.int64), np.zeros(0, np.int64)) == []


def test_token_files(spark, rows):
    path = public.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    found = tokenfile.token_digest(table(spark, rows), path).orderBy("start").collect()
    assert len(found) == len(rows)
    at = 0
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x)
    text = {i: t for i, t, _ in rows}
    for r in found:
        want = np.asarray([*tool.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_token_files_name_their_documents(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(tokenfile, "FILE_IDS", 400)
    path = public.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    more = [*rows, (9000, "very long " * 40_000, "s1"), (None, "another without an id", "s1")]
    tokenfile.write_token_files(table(spark, more), path, str(tmp_path / "ids"))
    files = [tokenfile.TokenFile(p.read_bytes()) for p in (tmp_path / "ids").glob("part-*") if p.stat().st_size]
    found, at = [], {}
    for file in sorted(files, key=lambda f: (f.part, f.number)):
        assert file.before == at.get(file.part, 0) and file.ids == file.lengths.sum() and (file.ids <= 400 or len(file.lengths) == 1)
        at[file.part] = file.before + file.ids
        found += [(i, zlib.crc32(file.document(k).tobytes())) for k, i in enumerate(file.doc_ids)]
    want = [(i, zlib.crc32(np.asarray([*tool.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, t, _ in more]
    assert collections.Counter(found) == collections.Counter(want) and [x for x, _ in found] == sorted((x for x, _, _ in more), key=lambda x: -1 if x is None else x)


def test_packing_keeps_documents_whole(spark):
    rng = random.Random(4)
    path = public.path("word_bpe_49k.json")
    docs = [(k, " ".join(rng.choice(("one", "two", "three")) for _ in range(rng.choice((3, 20, 200, 300)))), "s0") for k in range(400)]
    docs.append((400, "one two " * 40_000, "s1"))
    found = packing.pack(table(spark, docs), path).collect()
    pieces = collections.Counter(r["doc_id"] for r in found)
    assert all(pieces[r["doc_id"]] == -(-r["doc_tokens"] // 2048) for r in found)
    used, ids = max(r["sequence_id"] for r in found) + 1, sum(r["length"] for r in found)
    assert used <= -(-ids // 2048) + 2


def test_encoder_forgets_and_keeps_right():
    from tokenizers import Tokenizer

    rng = random.Random(8)
    tool = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    encoder = tokens.PieceTokenizer(public.path("byte_bpe_50k.json"), limit=60)
    for _ in range(30):
        batch = ["".join(rng.choice("ab cd\n\n.,'!1\u00e9\t x") for _ in range(rng.randint(0, 40))) for _ in range(50)]
        ids, counts = encoder.encode(pa.array(batch, pa.string()))
        want = [tool.encode(t, add_special_tokens=False).ids for t in batch]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_patched_blocks_round_trip():
    rng = np.random.default_rng(6)
    shapes = [np.zeros(0, "<u4"), np.array([7], "<u4"), np.full(500, 9, "<u4"), rng.integers(0, 2**32, 300, dtype=np.uint64).astype("<u4"), np.array([0, 2**32 - 1] * 200, "<u4")]
    mixed = rng.integers(0, 50, 1000).astype("<u4")
    mixed[::40] = 2**31
    for ids in [*shapes, mixed]:
        file = tokenfile.TokenFile(tokenfile.encode_file([ids[:3], ids[3:]]))
        assert (file.all() == ids).all() and (file.document(0) == ids[:3]).all() and (file.document(1) == ids[3:]).all()
    with pytest.raises(ValueError):
        tokenfile.TokenFile(b"nope" + bytes(12))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_equal_whole_texts(name):
    from tokenizers import Tokenizer

    odd = ["a  b", " x y \n z ", "\tq  r", "it's <|endoftext|> we're", "", None, "don't  \n\n stop", "é́ x ΑΣ Σ", "12 345\x1c a", " ", "x ", "a  b", "A,B. C.D, É, x.,", "'s, ''. 3, 3.", "a.\nB c,\nD\n", "e###\nf*** g", "x\n\ny z\n a", "日本 語,テスト. ok", "İstanbul İ, ı."]
    encoder, tool = tokens.PieceTokenizer(public.path(name), limit=40), Tokenizer.from_file(public.path(name))
    for batch in (odd, odd[::-1], [t for _, t, _ in corpus()]):
        ids, counts = encoder.encode(pa.array(batch, pa.string()), 7)
        want = [[*tool.encode(t or "", add_special_tokens=False).ids, 7] for t in batch]
        assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


def test_lm_scores(spark, rows):
    found = lmscore.lm_scores(table(spark, rows)).collect()
    counts = collections.Counter()
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    for i, t, _ in rows:
        if lmscore.fold(i) != 2:
            counts.update(split(t))
    n, v = sum(counts.values()), len(counts)
    text = {i: t for i, t, _ in rows}
    assert len(found) == len(rows)
    for r in found:
        w = split(text[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (lmscore.fold(r["doc_id"]) == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_network_probabilities_sum_to_one_and_gradients_fit():
    counts = np.array([50.0, 30, 20, 10, 5, 5, 3, 100])
    net = lmscore.Network(counts, seed=1)
    states = np.random.default_rng(0).normal(size=(1, lmscore.HIDDEN)).astype(np.float32) * 0.3
    total = sum(np.exp(net.log_probs(states, np.array([k]))[0]) for k in range(len(counts)))
    assert total == pytest.approx(1, abs=1e-5)
    ids = np.array([[0, 1], [3, 7], [2, 2]])
    logp, grads, _ = net.log_probs(np.repeat(states, 6, axis=0), ids.reshape(-1), train=True)
    eps, k = 1e-3, 0
    net.params[3][k] += eps
    up = net.log_probs(np.repeat(states, 6, axis=0), ids.reshape(-1)).sum()
    assert (logp.sum() - up) / eps == pytest.approx(grads[1][k], rel=0.05, abs=0.02)


def test_network_learns_order():
    rng = np.random.default_rng(2)
    net, lanes = lmscore.Network(np.full(6, 100.0)), lmscore.Lanes(lanes=8, steps=16)
    for _ in range(150):
        start = rng.integers(0, 6)
        lanes.add((start + np.arange(40)) % 6)
    state = np.zeros((8, lmscore.HIDDEN), np.float32)
    for at, ids, starts, _ in lanes.windows(last=True):
        state[at] = net.learn(ids, starts, state[at])
    ids = ((np.arange(40)) % 6)[:, None]
    starts = np.zeros((40, 1), bool)
    starts[0] = True
    states, _, _ = net.run(ids, starts, np.zeros((1, lmscore.HIDDEN), np.float32))
    assert net.log_probs(states.reshape(40, -1), ids.reshape(-1))[5:].mean() > np.log(1 / 6) + 0.5


def test_network_state_is_whole():
    net = lmscore.Network(np.full(6, 100.0))
    states, last, _ = net.run(np.zeros((3, 2), np.int64), np.zeros((3, 2), bool), np.zeros((2, 16), np.float32))
    assert states.shape == (3, 2, 16) and last.shape == (2, 16) and [p.shape for p in net.params[:2]] == [(6, 48), (16, 48)]


def test_lanes_keep_documents_whole():
    lanes, seen = lmscore.Lanes(lanes=3, steps=4), collections.defaultdict(list)
    docs = [np.arange(n) for n in (1, 9, 30, 2, 5, 17, 1)]
    for k, d in enumerate(docs):
        lanes.add(d)
        for _, ids, starts, numbers in lanes.windows(last=k == len(docs) - 1):
            for t in range(len(ids)):
                for lane in range(ids.shape[1]):
                    assert starts[t, lane] == (not seen[int(numbers[t, lane])])
                    seen[int(numbers[t, lane])].append(int(ids[t, lane]))
    assert {k: v for k, v in seen.items()} == {k: d.tolist() for k, d in enumerate(docs)}


def test_line_dedup(spark):
    rows = [
        (1, "alpha beta gamma delta\nReleased on 2020-01-01 by the team\nx y", "s"), (2, "foo bar baz qux\nReleased on 2021-05-01 by the team\nx y", "s"),
        (3, "Released on 2022-05-01 by the team\nunique words go here", "s"), (4, None, "s"), (5, "", "s"), (None, "Released on 1 by the team\nzzz yyy xxx", "s"),
        (9, "same line in two\nok then fine", "s"), (10, "same line in two", "s"), (20, "dup text here now", "s"), (20, "dup text here now", "s"), (21, "dup text here now", "s"), (22, "dup text here now", "s"),
        *[(40 + k, f"on the page {w} all was changed by our editors in spring again", "s") for k, w in enumerate("home news sport food help jobs maps mail shop art law".split())],
    ]
    docs = table(spark, rows)
    out = linedup.drop_recurring_lines(docs)
    assert out.columns == docs.columns
    found = collections.defaultdict(list)
    for r in out.collect():
        found[r["doc_id"]].append(r["text"])
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))
    assert found[1] == [rows[0][1]] and found[2] == ["foo bar baz qux\nx y"] and found[3] == ["unique words go here"]
    assert found[None] == ["zzz yyy xxx"] and found[4] == [None] and found[5] == [""]
    assert found[9] == [rows[6][1]] and found[10] == [rows[7][1]]
    assert found[20] == ["dup text here now"] * 2 and found[21] == [""] and found[22] == [""]
    assert found[40] == [rows[12][1]] and all(found[k] == [""] for k in range(41, 51))


def test_line_dedup_families_in_one_leaf(spark):
    names = ["".join(w) for w in itertools.product("bdfg", "aeio", "lmnr")]
    one = [f"please contact our office in {w} for any further help or advice" for w in names[:30]]
    two = [f"please contact our editors when you have {w} and think it wrong" for w in names[30:60]]
    lone = ["please contact our " + " ".join(f"{w}{c}" for c in "stuvwxyzq") for w in names[:20]]
    one_document = "\n".join(f"please contact our shops near {w} when the weather is nice" for w in names[:5])
    common = [f"please contact our staff about {w} before the end of may" for w in ["cars"] * 20 + ["kites"]]
    texts = one + two + lone + [one_document] + common
    found = {r["doc_id"]: r["text"] for r in linedup.drop_recurring_lines(table(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    left = {0: one[0], 30: two[0], **{60 + k: t for k, t in enumerate(lone)}, 80: one_document, 81: common[0]}
    assert found == {k: left.get(k, "") for k in range(len(texts))}


def test_line_dedup_short_and_long_lines(spark):
    passage, script = " ".join(f"word{c}{d}" for c in "abcdefgh" for d in "stuvwxyz"), "許諾条項" * 12
    texts = [f"Read more\n{script if k < 4 else 'own'}\n  \n{passage if k in (2, 7) else ''}" for k in range(12)] + ["Go on"] * 9
    found = {r["doc_id"]: r["text"] for r in linedup.drop_recurring_lines(table(spark, [(k, t, "s") for k, t in enumerate(texts)])).collect()}
    want = {k: f"{'' if k < 4 else 'own' + chr(10)}  \n{passage if k == 2 else ''}" for k in range(12)}
    want = {k: t if k != 7 else "own\n  " for k, t in want.items()} | {k: "Go on" for k in range(12, 21)} | {0: texts[0]}
    assert found == want


def test_empty_tables(spark):
    none, labels = table(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    path = public.path("word_bpe_49k.json")
    results = [
        mixing.mixing_digest(none), mixing.mix_sources(none), sharding.shard_digest(none), quality.quality_digest(none, labels), quality.keep_quality(none, labels), neardup.near_duplicates(none),
        neardup.drop_near_duplicates(none), packing.pack(none, path), tokenfile.token_digest(none, path), lmscore.lm_scores(none), linedup.drop_recurring_lines(none), linedup.line_digest(none),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    assert none.select(F.lit(1)).count() == 0


def test_lm_scores_do_not_depend_on_the_layout(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "SHARD_TOKENS", 6000)
    rng = random.Random(11)
    chain = {k: [rng.randrange(60) for _ in range(3)] for k in range(60)}

    def say(n):
        k, out = rng.randrange(60), []
        for _ in range(n):
            out.append(f"w{k}")
            k = rng.choice(chain[k])
        return " ".join(out)

    docs = [(k, say(rng.choice((20, 60, 150))), "s0") for k in range(400)] + [(None, say(40), "s0"), (1000, say(9000), "s0")]
    one, many = ({r["doc_id"]: r for r in lmscore.lm_scores(table(spark, docs).repartition(n)).collect()} for n in (1, 8))
    assert len(one) == len(docs)
    for i, r in one.items():
        assert r["score"] == pytest.approx(many[i]["score"], rel=1e-4)
    held = [r for r in one.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def plain_log_prob(net, symbols):
    """Step by step, one token after the other, in double precision."""
    wx, wh, wc, bc, ww, bw = (p.astype(np.float64) for p in net.params)
    h, s, total = lmscore.HIDDEN, np.zeros(lmscore.HIDDEN), 0.0
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    for k in symbols:
        c = net.cls[k]
        mates = np.flatnonzero(net.cls == c)
        total += soft(s @ wc + bc)[c] + soft(ww[mates] @ s + bw[mates])[list(mates).index(k)]
        x, y = wx[k], s @ wh
        z, r = (1 / (1 + np.exp(-(x[a : a + h] + y[a : a + h]))) for a in (0, h))
        s = z * s + (1 - z) * np.tanh(x[2 * h :] + r * y[2 * h :])
    return total


def test_lanes_score_whole_documents():
    rng = np.random.default_rng(5)
    net = lmscore.Network(np.array([50.0, 30, 20, 10, 5, 5, 3, 100]), seed=1)
    docs = [rng.integers(0, 8, n) for n in (1, 5, 40, 200, 3, 700)]
    train, state = lmscore.Lanes(4, 8), np.zeros((4, lmscore.HIDDEN), np.float32)
    for d in docs:
        train.add(d)
    for at, ids, starts, _ in [*train.windows(), *train.windows(last=True)]:
        state[at] = net.learn(ids, starts, state[at])
    lanes, state, got = lmscore.Lanes(3, 16), np.zeros((3, lmscore.HIDDEN), np.float32), np.zeros(len(docs))
    for d in docs:
        lanes.add(d)
    for at, ids, starts, numbers in [*lanes.windows(), *lanes.windows(last=True)]:
        states, state[at], _ = net.run(ids, starts, state[at])
        np.add.at(got, numbers.reshape(-1), net.log_probs(states.reshape(-1, lmscore.HIDDEN), ids.reshape(-1)))
    assert got == pytest.approx([plain_log_prob(net, d) for d in docs], rel=1e-4)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(8)
    net = lmscore.Network(np.array([50.0, 30, 20, 10, 5, 5, 3, 100]), seed=2)
    symbols = rng.integers(0, 8, 14)
    before = [p.astype(np.float64) for p in net.params]
    net.squares = [np.full(p.shape, 100, np.float32) for p in net.params]  # steps stay small and near linear
    starts = (np.arange(14) == 0)[:, None]
    net.learn(symbols[:, None], starts, np.zeros((1, lmscore.HIDDEN), np.float32))
    step = 1e-5
    for k, old in enumerate(before):
        got = (old - net.params[k]) * 10 / lmscore.RATE * lmscore.STEPS
        for at in rng.permutation(old.size)[:60]:
            ends = []
            for sign in (1, -1):
                moved = [p.copy() for p in before]
                moved[k].reshape(-1)[at] += sign * step
                ends.append(-plain_log_prob(types.SimpleNamespace(params=moved, cls=net.cls), symbols))
            assert got.reshape(-1)[at] == pytest.approx((ends[0] - ends[1]) / (2 * step), rel=1e-2, abs=2e-4)


def test_scores_equal_plain_steps_and_shares(spark, rows, monkeypatch):
    monkeypatch.setattr(lmscore, "VOCABULARY", 30)
    monkeypatch.setattr(lmscore, "HEAD", 50)
    learned, kept = lmscore._learned, []
    monkeypatch.setattr(lmscore, "_learned", lambda *a: kept.append(learned(*a)) or kept[-1])
    more = [*rows, (7001, " ".join(f"w{k % 37}" for k in range(5000)), "s1")]
    found = lmscore.lm_scores(table(spark, more)).collect()
    split = lambda t: [*(t or "").encode().lower().split(), b" "]
    counts = collections.Counter(w for i, t, _ in more if lmscore.fold(i) != 2 for w in split(t))
    top = sorted(counts, key=lambda w: (-counts[w], w))[:30]
    others = sum(counts.values()) - sum(counts[w] for w in top)
    net = lmscore.Network(np.array([*(counts[w] for w in top), others], np.float64))
    net.unpack(kept[0])
    share = math.log10(others + len(counts) - 30 + 1)
    text = {i: t for i, t, _ in more}
    for r in found:
        words = split(text[r["doc_id"]])
        want = plain_log_prob(net, [top.index(w) if w in top else 30 for w in words]) / math.log(10)
        want += sum(math.log10(counts[w] + 1) - share for w in words if w not in top)
        assert r["score"] == pytest.approx(want, rel=1e-4)


def test_training_documents_stay_whole():
    lanes = lmscore.Lanes(lanes=2, steps=4, longest=lmscore.REACH)
    lanes.add(np.arange(2000) % 7)
    windows = list(lanes.windows(last=True))
    assert sum(w[2].sum() for w in windows) == 1 and max(len(w[1]) for w in windows) <= lmscore.REACH
    many = lmscore._even_lanes([np.full(n, k % 9, "<u2") for k, n in enumerate([900, 10, 30, 2000, 700, *[50] * 300])])
    assert len(many.rows) == 9 and many.sizes.max() - many.sizes.min() < 350 and len(lmscore._even_lanes([np.zeros(3, "<u2")]).rows) == lmscore.FEWEST
    assert sum(w[2].sum() for w in many.windows(last=True)) == 305
    dealt = list(lmscore._symbols(types.SimpleNamespace(value=pickle.dumps({"words": [b"a"]})), 2, 3)(iter([pa.RecordBatch.from_arrays([pa.array([next(k for k in range(99) if lmscore.fold(k) != 2)], pa.int64()), pa.array([b"a " * 3000], pa.binary())], names=["doc_id", "text"])])))
    assert [len(x) for b in dealt for x in b.column(3).to_pylist()] == [2 * 3001]
