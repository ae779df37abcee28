"""Hard negatives, spelling variants and repeated passages against brute force, and on awkward rows."""

import collections
import hashlib
import math
import os
import random
import re
import string
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from strideframe.llm import negatives, queries, substrings, variants

SF = "/root/testdata/sf0.001"


def hard_negatives(rows):
    """rows: (vec_id, vector or None, label); the digest by comparing everything."""
    usable = []
    for k, (i, v, label) in enumerate(rows):
        if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v):
            usable.append((k, i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for k, i, v, label in usable:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m, other) for m, j, w, other in usable if m != k)
        for p, j, _, _ in [x for x in scored if x[3] == label][:5]:
            fit = [(s, n) for s, n, _, other in scored if other != label and 50 * -p <= 100 * -s <= 95 * -p]
            out += [(i, j, rank, n, -p, -s) for rank, (s, n) in enumerate(fit[:3], 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


@pytest.mark.parametrize(("anchors", "rows_of_block"), [(4096, 4096), (3, 17)])
def test_hard_negatives(spark, monkeypatch, anchors, rows_of_block):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "ROWS", rows_of_block)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 12))
    rows = []
    for i in range(600):
        v = centres[i % 5] + rng.normal(size=12) * (0.3 if i % 3 else 1.5)
        rows.append((i, (v / np.linalg.norm(v)).tolist(), int(rng.integers(0, 4))))
    rows += [(600 + k, rows[50][1], k % 2) for k in range(40)]  # ties
    rows += [(650, None, 1), (700, [math.nan] * 12, 1), (750, [None] + [0.0] * 11, 2), (800, [1.0] * 12, None), (None, [1.0] * 12, 1)]
    rows += [(850, [0.0] * 12, 1), (900, [], 1), (901, [0.5, 0.5], 1), (950, [1e6] * 12, 2), (951, [9e5] * 12, 2), (952, [-5e5] * 12, 1), (953, [7e5] * 12, 1)]
    df = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], "vec_id long, embedding array<double>, label int, row int, cell int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in negatives.negative_digest(df).collect())
    want = hard_negatives(rows)
    assert want
    assert got == want
    assert negatives.negative_digest(df.limit(0)).count() == 0


def test_hard_negatives_repeated_rows_and_long_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(k % 60, rng.normal(size=2000).tolist(), k % 2) for k in range(120)] + [(100, [1e300] * 2000, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in negatives.negative_digest(df).collect())
    assert got == hard_negatives(rows[:-1])


def test_few_open_pairs_are_scored_one_by_one(monkeypatch):
    rng = np.random.default_rng(5)
    make = lambda n, at: {"row": np.arange(n) + at, "vec_id": np.arange(n) + at, "label": rng.integers(0, 2, n), "vector": np.floor(rng.normal(size=(n, 6)) * 90)}
    asked, rows = make(40, 0), make(300, 100)
    top = max(float((x["vector"] ** 2).sum(axis=1).max()) for x in (asked, rows))
    pivot, lift = rows["vector"][:3], np.sqrt(top - (rows["vector"][:3] ** 2).sum(axis=1))
    for x in (asked, rows):
        x["square"] = (x["vector"] ** 2).sum(axis=1)
    flat = lambda v: np.stack([((v - p) ** 2).sum(axis=1) for p in pivot], axis=1)
    asked["to"] = np.sqrt(flat(asked["vector"]) + lift**2)
    rows["to"] = np.sqrt(flat(rows["vector"]) + (np.sqrt(top - rows["square"])[:, None] - lift) ** 2)
    lows, highs = [np.array([20_000, 1000])] * 40, [np.array([30_000, 5000])] * 40
    found = []
    for few in (0.0, 1.0):
        monkeypatch.setattr(negatives, "FEW", few)
        found.append(negatives.best_of(asked, rows, lows, highs, 3, top, False))
    for a, b in zip(*found, strict=True):
        assert (a == b).all()
    assert len(found[0][0]) > 20


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def spelling(count):
    """{word: (form, root, n, n_near, form_n)} of a vocabulary by comparing all words."""
    near = {w: [x for x in count if one_edit(w, x)] for w in count}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 10 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n, len(near[w]), count.get(form[w])) for w, n in count.items()}


def vocabulary_of(rows):
    count = collections.Counter()
    lower = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    for i, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def result(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling_of_documents(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(40)] + ["straße\u00D7\u00F7x", "ÀÉÎabcdefg", "aaaaaaaa", "aaaaaaa"]
    rows = []
    for i in range(200):
        words = [rng.choice(base[:8] * 9 + base) for _ in range(rng.randint(0, 150))]
        words = [w.upper() if rng.random() < 0.1 else w for w in words]
        words = [w[:2] + rng.choice("xyé") + w[3:] if rng.random() < 0.03 else w for w in words]
        rows.append((i, rng.choice([" ", ", ", "-1 "]).join(words)))
    giant = "".join(rng.choice("abcdefgh") for _ in range(40_000))
    rows += [(None, " ".join(base)), (7, rows[7][1]), (300, None), (301, ""), (302, " ".join(base * 700)), (303, giant), (304, giant), (305, giant[:-1]), (306, giant[:-1])]
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, word string, n long")
    got, want = result(variants.variant_digest(df)), spelling(vocabulary_of(rows))
    assert got == want
    assert sum(x[0] is not None for x in want.values()) > 10
    assert variants.variant_digest(df.limit(0)).count() == 0


def test_forms_are_followed_to_the_last(spark):
    count = {"aaaaaaa": 1, "aaaaaab": 10, "aaaaabb": 100, "aaaabbb": 1000, "aaabbbb": 10_000, "aaabbbc": 10_000, "zzzz": 5}
    df = spark.createDataFrame([(w, n) for w, n in count.items()] + [("zzzz", 2), (None, 3), ("", 4), ("q", None)], "word string, n long")
    got = result(variants.spelling_variants(df))
    assert got == spelling(count | {"zzzz": 7})
    assert got["aaaaaaa"][1] == "aaabbbb" and got["aaabbbc"][0] is None


@pytest.mark.parametrize("word", ["a", "aa", "aabbcabb", "abcdefé", "aaaaaaaaaaab"])
def test_neighbourhood_is_whole_and_distinct(word):
    alphabet = variants.letters("abcdé")
    want = {word[:k] + word[k + 1 :] for k in range(len(word))}
    want |= {word[:k] + x + word[k + 1 :] for k in range(len(word)) for x in "abcdé"}
    want |= {word[:k] + x + word[k:] for k in range(len(word) + 1) for x in "abcdé"}
    got = []
    for hashes, _, places, put, taken in variants.neighbourhoods([word], alphabet, size=11):
        for h, at, x in zip(hashes.tolist(), places.tolist(), put.tolist(), strict=True):
            made = word[:at] + (chr(x) if x else "") + word[at + taken :]
            assert variants.word_hash(made) == h
            got.append(made)
    assert len(got) == len(set(got))
    assert set(got) == want - {word}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_hardneg", "op12_spelling", "op13_substring"])
def test_searches_equal_their_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    plain = lambda x: "null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[columns].astype(object).itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def repeats(rows, window=20):
    """Per row of (doc_id, text): (doc_id, words, removed words, checksum, kept words), by a dictionary of all windows."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    place = lambda i, s: (i is None, i or 0, s)
    first = {}
    for (i, _), w in zip(rows, words, strict=True):
        for s in range(len(w) - window + 1):
            said = tuple(w[s : s + window])
            first[said] = min(first.get(said, place(i, s)), place(i, s))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < place(i, s):
                gone.update(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def passages():
    rng = random.Random(6)
    say = lambda n, size=400: [f"w{rng.randrange(size)}" for _ in range(n)]
    shared = [say(60), say(25), say(20), say(19), ["a"] * 70, ["a", "b", "c"] * 20, (say(7) * 9)]
    rows = []
    for i in range(150):
        words = say(rng.randint(0, 90))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            piece = list(rng.choice(shared))
            if rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = "edit"
            words[at:at] = piece
        rows.append((rng.randrange(1000) if i % 10 else i, rng.choice([" ", "\n", "\t "]).join(words)))
    long = say(30_000, 50_000)
    rows += [(2000, " ".join(long)), (2001, " ".join(long[:9000] + ["x"] + long[9000:])), (2002, "z " * 5000), (2003, "z " * 30)]
    rows += [(None, rows[3][1]), (None, " ".join(shared[0])), (5, None), (6, ""), (7, "  \t "), (2004, rows[0][1]), rows[20], rows[20], (rows[21][0], "q " + rows[21][1])]
    rows += [(2005, "é\u00a0ü " * 25), (2006, "é\u00a0ü " * 25), (2007, "y" * 300_000 + " end"), (2008, " ".join(["Éa", "éa"] * 15))]
    return rows


@pytest.mark.parametrize(("hot", "shard"), [(2000, 1 << 17), (3, 300)])
def test_repeated_passages(spark, monkeypatch, hot, shard):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)
    rows = passages()
    df = spark.createDataFrame([(i, t, "x", 1, "p") for i, t in rows], "doc_id long, text string, key string, start int, print string")
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.repeat_digest(df.repartition(5)).collect())
    assert got == collections.Counter(x[:4] for x in repeats(rows))
    assert substrings.repeat_digest(df.limit(0)).count() == 0


def test_texts_without_repeats(spark):
    rows = passages()[:40]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, print string, spans string")
    got = substrings.drop_repeats(df)
    assert got.schema == df.schema
    want = collections.Counter((i, t if not removed else kept, "x", "y") for (i, t), (_, _, removed, _, kept) in zip(rows, repeats(rows), strict=True))
    assert collections.Counter(tuple(r) for r in got.collect()) == want


def test_index_counts_and_finds():
    rng = np.random.default_rng(7)
    for size in (2, 3, 40, 300):
        text = np.append(rng.integers(1, size, 1000), 0)
        tree = substrings.WaveletTree(text, size)
        symbol, place = rng.integers(0, size, 500), rng.integers(0, 1002, 500)
        assert (tree.count(symbol, place) == [int((text[:p] == s).sum()) for s, p in zip(symbol, place, strict=True)]).all()
    text = np.append(np.tile(rng.integers(1, 9, 50), 5), 0)
    first = np.arange(len(text) - 20)
    at, low = substrings.FMIndex(text, 9).intervals(text, first)
    said = [tuple(text[k : k + 20]) for k in first]
    count = collections.Counter(said)
    assert at.tolist() == [k for k in first if count[said[k]] > 1]
    assert len(set(low.tolist())) == len({said[k] for k in at}) == len({(a, said[k]) for a, k in zip(low.tolist(), at, strict=True)})


def test_equal_windows_have_equal_keys():
    rng = np.random.default_rng(8)
    lengths = rng.integers(0, 120, 60)
    hashes = rng.integers(0, 5, lengths.sum()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    text, first, windows, key, content, several = substrings.segments(hashes, lengths)
    ends = np.cumsum(lengths)
    assert sum(windows) == sum(max(0, n - 19) for n in lengths)
    keys, places = {}, collections.defaultdict(list)
    for t, f, n, k, c, s in zip(text, first, windows, key, content, several, strict=True):
        assert ends[t] - lengths[t] <= f and f + n + 19 <= ends[t]
        for p in range(f, f + n):
            said = tuple(hashes[p : p + 20])
            assert keys.setdefault(said, k) == k
            assert s or said not in places[(c, f)]
            places[(c, f)].append(said)
