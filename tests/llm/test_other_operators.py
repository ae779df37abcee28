"""Embeddings, urls, the pipeline, and queries with SQL."""

import math
import os
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strideframe.llm import components, embdup, queries, urlfilter
from strideframe.llm.common import WorkTables

SF = "/root/testdata/sf0.001"
HERE = os.path.isdir(SF)


def brute(vectors, cosine):
    """vectors: (id, list or None); returns n_links per row and component per id."""
    unit = []
    for i, v in vectors:
        ok = i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) if ok else None)
    links, top = [0] * len(vectors), {i: i for i, _ in vectors}
    find = lambda x: x if top[x] == x else find(top[x])
    for a, u in enumerate(unit):
        for b, w in enumerate(unit):
            if a != b and u is not None and w is not None and len(u) == len(w) and u @ w >= cosine:
                links[a] += 1
                ra, rb = find(vectors[a][0]), find(vectors[b][0])
                top[max(ra, rb)] = min(ra, rb)
    return links, find


@pytest.mark.parametrize(("small", "chunk"), [(12, 256), (1, 5)])
def test_embedding_duplicates(spark, monkeypatch, small, chunk):
    monkeypatch.setattr(embdup, "SMALL", small)
    monkeypatch.setattr(embdup, "CHUNK", chunk)
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 24))
    rows = [v.tolist() for v in base] + [(base[0] + rng.normal(size=24) * 0.05).tolist() for _ in range(30)] + [base[1].tolist()] * 6 + [(base[2] * 3).tolist()]
    rows += [None, [0.0] * 24, [math.nan] * 24, [1.0, None] + [0.0] * 22, [math.inf] * 24, [], base[3][:12].tolist()]
    vectors = list(enumerate(rows)) + [(None, base[0].tolist())]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, unit int")
    links, find = brute(vectors, 0.95)
    found = {r["vec_id"]: r for r in embdup.embedding_duplicates(df).collect()}
    assert len(found) == len(vectors)
    for (i, _), n in zip(vectors, links, strict=True):
        if i is None:
            assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (0, None, True)
        else:
            assert (found[i]["n_links"], found[i]["component_id"], found[i]["kept"]) == (n, find(i), find(i) == i)
    assert embdup.embedding_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize(("dim", "count"), [(1, 50), (2, 1000), (4, 1000), (8, 50_000), (16, 20_000), (64, 20_000), (64, 10_000_000), (768, 1_000_000)])
def test_filters_reach_pairs_at_the_threshold(dim, count):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, dim))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    r = rng.normal(size=v.shape)
    r -= (r * v).sum(axis=1, keepdims=True) * v
    w = v if dim == 1 else 0.95 * v + math.sqrt(1 - 0.95**2) * r / np.linalg.norm(r, axis=1, keepdims=True)
    size, alpha = embdup.plan_code(dim, count, 0.95)
    hit = np.zeros(300, bool)
    for k in range(embdup.ROTATIONS):
        (a, x), (b, y) = embdup.decode(v, size, k, alpha), embdup.decode(w, size, k, alpha)
        both = set(zip(a.tolist(), x.tolist(), strict=True)) & set(zip(b.tolist(), y.tolist(), strict=True))
        hit[[i for i, _ in both]] = True
    assert hit.mean() >= 0.98


def test_decoding_lists_all_filters():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(20, 13))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rotation, codes = embdup.code_book(16, 9, 4)
    full = np.concatenate([v, np.zeros((20, 3))], axis=1) @ rotation
    number = np.arange(9**3)
    words = np.concatenate([codes[0][number // 81], codes[1][number // 9 % 9], codes[2][number % 9]], axis=1)
    assert np.linalg.norm(words, axis=1) == pytest.approx(1)
    want = {(int(a), int(b)) for a, b in zip(*np.nonzero(full @ words.T >= 0.45), strict=True)}
    row, found = embdup.decode(v, 9, 4, 0.45)
    assert len(row) == len(want) > 50 and set(zip(row.tolist(), found.tolist(), strict=True)) == want


def test_recall_on_many_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(10_000, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = rng.normal(size=base.shape)
    near -= (near * base).sum(axis=1, keepdims=True) * base
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    cosines = rng.uniform(0.94, 0.97, (10_000, 1))
    every = np.concatenate([base, cosines * base + np.sqrt(1 - cosines**2) * near])
    unit = every / np.linalg.norm(every, axis=1, keepdims=True)
    links = np.zeros(len(unit), np.int64)
    for low in range(0, len(unit), 1000):
        links[low : low + 1000] = (unit[low : low + 1000] @ unit.T >= 0.95).sum(axis=1) - 1
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(every))), "embedding": pa.array(list(every))}))
    found = embdup.embedding_duplicates(df).toArrow()
    got = np.zeros(len(unit), np.int64)
    got[found.column("vec_id").to_numpy()] = found.column("n_links").to_numpy()
    assert (got <= links).all() and got.sum() >= 0.98 * links.sum() > 5000


def test_components(spark):
    tables = WorkTables(spark, "test")
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(7, 7), (200, 201), (201, 200)]
    found = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), tables).collect()}
    assert all(found[k] == 0 for k in range(41)) and all(found[100 + k] == 100 for k in range(30)) and found[201] == 200
    assert components.components(spark.createDataFrame([], "a long, b long"), tables).count() == 0


def test_url_filter(spark):
    captures = [("http://a.b.com/x", 5), ("HTTPS://user@A.b.com:80/", 15), ("http://www.b.com./", 5), ("http://c.org", 50), (None, 1), ("nonsense", 1), ("http://a.b.com", None), ("http://a.b.com/x", 25)]
    changes = [("b.com", "block", 0, "add"), ("b.com", "block", 20, "remove"), ("a.b.com", "allow", 10, "add"), ("C.org", "block", 10, "add"), ("c.org", "block", 10, "remove"), (None, "block", 1, "add")]
    df = spark.createDataFrame([(*c, "extra") for c in captures], "url string, fetched int, list string")
    lists = spark.createDataFrame(changes, "entry string, list string, day int, action string")
    found = [(r["host"], r["entry"], r["blocked"]) for r in urlfilter.filter_urls(df, lists).orderBy("url", "fetched").collect()]
    want = [(None, None, False), ("a.b.com", "a.b.com", False), ("a.b.com", None, False), ("a.b.com", "b.com", True), ("a.b.com", "a.b.com", False), ("c.org", "c.org", True), ("b.com", "b.com", True), (None, None, False)]
    assert sorted(map(str, found)) == sorted(map(str, want))
    assert urlfilter.filter_urls(df.limit(0), lists).count() == 0
    assert urlfilter.filter_urls(df, lists.limit(0)).where("blocked").count() == 0


def test_url_filter_equals_brute_force(spark):
    rng = random.Random(6)
    hosts = ["a.b.c.d.e.f.g.h.i.j.com", "b.c.d.e.f.g.h.i.j.com", "x.org", "y.x.org", "hot.x.org"]
    suffixes = sorted({".".join(h.split(".")[k:]) for h in hosts for k in range(h.count(".") + 1)})
    changes = [(rng.choice(suffixes), rng.choice(("block", "allow")), rng.randrange(40), rng.choice(("add", "remove"))) for _ in range(150)]
    names = ("url", "fetched", "since", "until", "day", "__host", "blocked", "entry")
    captures = [(f"http://{rng.choice([*hosts, 'hot.x.org', 'hot.x.org'])}/{'p' * rng.choice((1, 1, 50_000))}", rng.randrange(45), k, "u", "d", "h", "mine", "mine") for k in range(300)]
    df, lists = spark.createDataFrame(captures, names), spark.createDataFrame(changes, "entry string, list string, day int, action string")

    def verdict(host, day):
        best = (0, False, None, None)
        for entry in suffixes:
            if host == entry or host.endswith("." + entry):
                for name in ("block", "allow"):
                    past = [(d, a == "add") for e, x, d, a in changes if (e, x) == (entry, name) and d <= day]
                    if past and max(past)[1]:
                        best = max(best, (len(entry), name == "allow", entry, name))
        return best[2], best[3], best[3] == "block"

    found = urlfilter.filter_urls(df, lists)
    assert found.columns == ["url", "fetched", "since", "until", "day", "__host", "host", "entry", "list", "blocked"]
    rows = {r["since"]: r for r in found.collect()}
    assert len(rows) == 300 == found.count()
    for url, day, k, *_ in captures:
        host = url.split("/")[2]
        assert (rows[k]["entry"], rows[k]["list"], rows[k]["blocked"]) == verdict(host, day) and rows[k]["until"] == "u" and rows[k]["host"] == host


def test_one_host_with_many_segments(spark):
    """Captures of one host are dealt to many keys, and each finds its segment among all."""
    changes = spark.range(1500).selectExpr("'hot.org' AS entry", "'block' AS list", "cast(id AS int) AS day", "IF(id % 2 = 0, 'add', 'remove') AS action")
    captures = spark.range(20_000).selectExpr("concat('http://hot.org/', id % 50) AS url", "cast(id % 1600 AS int) - 50 AS fetched", "id")
    captures = captures.unionByName(spark.createDataFrame([(None, 3, 1), ("http://hot.org/", None, 2), (None, None, 3)], "url string, fetched int, id long"))
    found = urlfilter.filter_urls(captures, changes)
    assert found.count() == 20_003
    wrong = found.where("blocked <> (host IS NOT NULL AND fetched IS NOT NULL AND fetched BETWEEN 0 AND 1498 AND fetched % 2 = 0)")
    assert wrong.count() == 0 and found.where("blocked").count() > 9000


@pytest.mark.skipif(not HERE, reason="no test tables")
@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - {"op11_hardneg", "op12_spelling", "op13_substring"}))  # those: test_searches.py
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda v: "null" if v is None or v != v else repr(float(v)) if isinstance(v, float) else str(v)
    rows = lambda df: sorted(tuple(map(plain, r)) for r in df[sorted(got.columns)].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.skipif(not HERE, reason="no test tables")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        if name != "source mixing":
            assert after.count() <= before.count()
        before = WorkTables(spark, "t").save(after)
    packed = corpus_pipeline.run(spark, SF)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0
    assert packed.count() > 0
