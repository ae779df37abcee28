"""Queries of the relational core: prompts, ingestion, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import text
from ..operators import ingest, manifests, prompts

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PROMPT = prompts.Prompt(and_tokens=("l",), or_tokens=("BOLT", "anvil", "gear"), and_not_tokens=("old",), minimum_duration=5, maximum_duration=45)
TOKENS = ("bolt", "GEAR", "anvil", "no such token")


# P-01, P-02, P-05, X-17
@query("""SELECT p_partkey, p_name, p_size FROM part
WHERE p_name ILIKE '%l%' AND (p_name ILIKE '%bolt%' OR p_name ILIKE '%anvil%' OR p_name ILIKE '%gear%')
  AND NOT (p_name ILIKE '%old%') AND p_size > 5 AND p_size < 45""")
def q01_token_select(spark, sf_dir):
    return prompts.select_videos(table(spark, sf_dir, "part"), PROMPT, "p_name", "p_size").select("p_partkey", "p_name", "p_size")


# X-15, P-03, A-02
@query("""WITH t(token) AS (VALUES ('bolt'), ('GEAR'), ('anvil'), ('no such token')),
c AS (SELECT t.token, count(p.p_partkey) AS n FROM t LEFT JOIN part p ON p.p_name ILIKE '%' || t.token || '%' AND NOT p.p_name ILIKE '%small%' GROUP BY 1)
SELECT token, n AS n_chapters FROM c UNION ALL SELECT NULL, sum(n)::BIGINT FROM c""")
def q02_token_fanout(spark, sf_dir):
    return prompts.token_counts(table(spark, sf_dir, "part"), TOKENS, ("small",), "p_name").select("token", F.col("n_chapters").cast("long").alias("n_chapters"))


# F-01..F-04
@query("""WITH e AS (SELECT event_id, event_type AS id, value - 2 AS s, value + 3.7 AS e FROM events)
SELECT event_id, 'https://youtu.be/' || id || '?start=' || trunc(s)::INT || '&end=' || trunc(e)::INT AS link,
  id || '__' || greatest(0, trunc(s)::INT - 8) || '-' || (trunc(e)::INT + 8) || '__.mp4' AS clip,
  'https://www.youtube.com/embed/' || id || '?start=' || greatest(0, trunc(s)::INT - 8) || '&end=' || (trunc(e)::INT + 8) AS embed FROM e""")
def q03_links(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("id"), (F.col("value") - 2).alias("s"), (F.col("value") + 3.7).alias("e"))
    low, high = text.clip_bounds(F.col("s"), F.col("e"), 8)
    return rows.select("event_id", text.chapter_link(F.col("id"), F.col("s"), F.col("e")).alias("link"), text.clip_name(F.col("id"), low, high).alias("clip"), text.embed_link(F.col("id"), low, high).alias("embed"))


# A-01
@query("""WITH g AS (SELECT user_id, epoch_us(ts) / 1000000.0::DOUBLE AS s, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) / 1000000.0::DOUBLE AS e FROM events)
SELECT user_id, round(avg(e - s), 3) AS mean_length, round(stddev_pop(e - s), 3) AS std_length FROM g WHERE e IS NOT NULL GROUP BY 1""")
def q04_interval_stats(spark, sf_dir):
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select("user_id", seconds.alias("start_time"), F.lead(seconds).over(w).alias("end_time")).where("end_time IS NOT NULL")
    return prompts.interval_statistics(rows, by=["user_id"]).select("user_id", F.round("mean_length", 3).alias("mean_length"), F.round("std_length", 3).alias("std_length"))


# J-01, U-04, O-04, P-08, F-05, S-02, S-03
@query("""WITH p AS (SELECT page_id, url, right(split_part(url, '&t=', 1), 11) AS id FROM pages WHERE length(url) >= 11),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY page_id) AS n FROM p)
SELECT page_id, url, id FROM f WHERE n = 1 AND id NOT IN (SELECT id FROM p WHERE page_id % 2 = 0)""")
def q05_ingest_antijoin(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").where(text.valid_url(F.col("url"))).select("page_id", "url", text.id_from_url(F.col("url")).alias("id"))
    return ingest.new_rows(ingest.first_wins(rows, "id", "page_id"), rows.where("page_id % 2 = 0"), "id").select("page_id", "url", "id")


# S-23, J-12
@query("""SELECT o_orderkey, o_custkey, CASE WHEN c_custkey IS NULL THEN 'no parent' END AS reason
FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey""")
def q06_fk_rejects(spark, sf_dir):
    parents = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    found = ingest.check_reference(table(spark, sf_dir, "orders"), parents, "o_custkey", "c_custkey")
    good = found.accepted.select("o_orderkey", "o_custkey", F.lit(None).cast("string").alias("reason"))
    return good.unionByName(found.rejected.select("o_orderkey", "o_custkey", "reason"))


# P-21, P-22
@query("""SELECT event_id, coalesce(json_extract_string(props, '$.k'), '-1') AS k, coalesce(json_extract_string(props, '$.missing'), '') AS title,
  (len(json_keys(props)) - CASE WHEN json_exists(props, '$.k') THEN 1 ELSE 0 END)::INT AS other_keys FROM events""")
def q07_info_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    other = F.size(F.map_keys(ingest.drop_keys(F.from_json("props", "map<string,string>"), ["k", "absent"])))
    return rows.select("event_id", ingest.json_field(F.col("props"), "k", "-1").alias("k"), ingest.json_field(F.col("props"), "missing", "").alias("title"), other.cast("int").alias("other_keys"))


# P-16, U-01, A-04
@query("""WITH c(label) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW'), ('9-NONE')),
a AS (SELECT o_orderpriority AS label FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'O')
SELECT c.label, count(a.label) AS n_rows FROM c LEFT JOIN a USING (label) GROUP BY 1""")
def q20_class_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "label")
    return manifests.class_counts(rows.where("o_orderstatus = 'O'"), rows.where("o_orderstatus = 'F'"), ["1-URGENT", "2-HIGH", "5-LOW", "9-NONE"])


# A-03
@query("""SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_files, count(*)::DOUBLE / count(DISTINCT o_custkey) AS rows_per_file FROM orders""")
def q20b_link_statistics(spark, sf_dir):
    return manifests.link_statistics(table(spark, sf_dir, "orders"), "o_custkey")


# J-08, J-09
@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def q21_semi_allowlist(spark, sf_dir):
    return manifests.allowed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality = 1"), "doc_id").select("doc_id", "lang", "n_chars")


# J-11, F-11
@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def q22_substring_join(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("part"))
    return manifests.contains_join(texts, parts, "doc_id", "text", "item_id", "part")


# S-33, F-06, F-08..F-10, P-07
@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '[^/]*$') AS name FROM pages),
n AS (SELECT page_id, name, CASE page_id % 3 WHEN 0 THEN 'a__nonsteady_' WHEN 1 THEN 'a__steady_' ELSE 'a_' END || name AS routed FROM p)
SELECT page_id, CASE WHEN contains(routed, 'nonsteady') THEN 'nonsteady' WHEN contains(routed, 'steady') THEN 'steady' END AS bucket,
  right(regexp_replace(name, '\.[^.]*$', ''), 11) AS id, regexp_extract(name, '\.[^.]+$') AS extension, split_part(name, '.', 1) AS short_stem,
  regexp_replace(name, '\.[^.]*$', '') || '__steady_' || CASE WHEN length(page_id::VARCHAR) >= 5 THEN page_id::VARCHAR ELSE lpad(page_id::VARCHAR, 5, '0') END
    || '-' || CASE WHEN length((page_id * 400)::VARCHAR) >= 5 THEN (page_id * 400)::VARCHAR ELSE lpad((page_id * 400)::VARCHAR, 5, '0') END || '__.mp4' AS segment_name,
  right(name, 11) || '_' || page_id % 7 || '_' || page_id % 5 || '.mp4' AS fragment FROM n""")
def q23_route(spark, sf_dir):
    name = text.file_name(F.col("url"))
    mark = F.when(F.col("page_id") % 3 == 0, "a__nonsteady_").when(F.col("page_id") % 3 == 1, "a__steady_").otherwise("a_")
    rows = table(spark, sf_dir, "pages").select("page_id", name.alias("name0"), F.concat(mark, name).alias("name"))
    plain = F.col("name0")
    return manifests.route(rows, "steady_non_steady").select(
        "page_id", "bucket", text.id_from_stem(text.stem(plain)).alias("id"), text.extension(plain).alias("extension"), text.short_stem(plain).alias("short_stem"),
        text.segment_name(text.stem(plain), "steady", F.col("page_id"), F.col("page_id") * 400).alias("segment_name"),
        text.fragment_name(text.id_from_stem(plain), F.col("page_id") % 7, F.col("page_id") % 5).alias("fragment"),
    )


# S-32, J-10, F-02
@query("""SELECT p_partkey::VARCHAR AS id, 'https://www.youtube.com/watch?v=' || p_partkey AS link FROM part WHERE p_partkey % 3 <> 0""")
def q40b_videos_to_fetch(spark, sf_dir):
    videos = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    done = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".webm")).alias("name"))
    return manifests.videos_to_fetch(videos, done).select("id", "link")


# S-31
@query("""WITH c AS (SELECT 'v' || user_id AS video_id, value AS s, value + 5 AS e FROM events),
n AS (SELECT video_id || '__' || greatest(0, trunc(s)::INT - 1) || '-' || (trunc(e)::INT + 1) || '__.mp4' AS name, video_id FROM c)
SELECT name, count(*) AS n_rows FROM n WHERE name NOT IN (SELECT 'v' || user_id || '__' || greatest(0, trunc(value)::INT - 1) || '-' || (trunc(value + 5)::INT + 1) || '__.mp4' FROM events WHERE event_id % 2 = 0 AND event_id > 1024) GROUP BY 1""")
def q40c_chapter_clips(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    chapters = events.select(F.concat(F.lit("v"), F.col("user_id").cast("string")).alias("video_id"), F.col("value").alias("start_time"), (F.col("value") + 5).alias("end_time"), "event_id")
    low, high = text.clip_bounds(F.col("start_time"), F.col("end_time"))
    done = chapters.where("event_id % 2 = 0").select(text.clip_name(F.col("video_id"), low, high).alias("name"), F.col("event_id").alias("size"))
    return manifests.chapter_clips(chapters, done).groupBy("name").agg(F.count(F.lit(1)).alias("n_rows"))


# U-06
@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations)
SELECT conv_id, turn, role FROM l WHERE n = 1 AND conv_id % 4 <> 0""")
def q05b_last_wins(spark, sf_dir):
    rows = ingest.last_wins(table(spark, sf_dir, "conversations"), "conv_id", "turn").select("conv_id", "turn", "role")
    return ingest.difference(rows, rows.where("conv_id % 4 = 0"), ["conv_id"])


# S-18
@query(r"""WITH r AS (SELECT event_id, value, user_id FROM events),
a AS (SELECT 'https://v/' || user_id AS url, (event_id % 3600)::DOUBLE AS s, (event_id % 3600 + trunc(value)::INT % 40 - 5)::DOUBLE AS e, event_id % 9 AS k FROM r)
SELECT DISTINCT url, s AS start_time, e AS end_time, 'move ' || k AS label FROM a WHERE e > s AND e >= 0""")
def q43_annotations(spark, sf_dir):
    from ..sources import readers

    clock = lambda t: F.concat_ws(":", *[F.lpad(x.cast("int").cast("string"), 2, "0") for x in (F.floor(t / 3600), F.floor(t / 60) % 60, t % 60)])
    events = table(spark, sf_dir, "events").select("event_id", "user_id", (F.col("event_id") % 3600).alias("s"), (F.col("event_id") % 3600 + F.col("value").cast("int") % 40 - 5).alias("e"))
    entry = F.concat(F.lit("    "), clock(F.col("s")), F.lit(" - "), clock(F.col("e")), F.lit(" = move "), (F.col("event_id") % 9).cast("string"))
    lines = F.array(F.struct((F.col("event_id") * 2).alias("ordinal"), F.concat(F.lit("https://v/"), F.col("user_id").cast("string")).alias("value")), F.struct((F.col("event_id") * 2 + 1).alias("ordinal"), entry.alias("value")))
    return readers.annotations(events.where("e >= 0").select(F.col("event_id").alias("document"), F.inline(lines)), document="document")
