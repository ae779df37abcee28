"""Queries of keys, names, boxes and masks: single expressions and table operators on the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import ingest, manifests, prompts, registration, segments, sequence
from ..sources import schemas
from . import sequences
from .relational import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


# S-20, S-22, P-22
@query("SELECT c_custkey::VARCHAR AS id, c_name AS title, coalesce(CASE WHEN c_acctbal >= 0 THEN trunc(c_acctbal)::BIGINT END, -1) AS duration, CASE WHEN c_nationkey < 12 THEN c_mktsegment ELSE '{}' END AS info, NULL::VARCHAR AS channel_id FROM customer")
def q51_videos_with_defaults(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("title"), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal").cast("long")).alias("duration"),
        F.when(F.col("c_nationkey") < 12, F.col("c_mktsegment")).alias("info"), F.lit(None).cast("string").alias("channel_id"),
    )
    return schemas.empty(spark, schemas.VIDEO).unionByName(ingest.with_defaults(rows, {"duration": -1, "info": "{}"}))


# S-24
@query("""SELECT row_number() OVER (ORDER BY user_id::VARCHAR, event_id) AS chapter_id, event_type AS title, value::DOUBLE AS start_time, (value + 5)::DOUBLE AS end_time,
  'youtube' AS source, user_id::VARCHAR AS video_id FROM events""")
def q52_unfold_chapters(spark, sf_dir):
    chapter = F.struct("event_id", F.col("event_type").alias("title"), F.col("value").alias("start_time"), (F.col("value") + 5).alias("end_time"))
    videos = table(spark, sf_dir, "events").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.array_sort(F.collect_list(chapter)).alias("chapters"))
    return ingest.unfold_chapters(videos)


# S-25
@query("""WITH g AS (SELECT n_nationkey AS id FROM nation WHERE n_regionkey = 1), v AS (SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT id FROM g))
SELECT 'channel' AS kind, n_nationkey::BIGINT AS id FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'video', c_custkey FROM v
UNION ALL SELECT 'chapter', o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT id FROM g))""")
def q53_cascade_delete(spark, sf_dir):
    channels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), "n_regionkey")
    videos = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_nationkey").cast("long").alias("channel_id"))
    chapters = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("video_id"))
    left = ingest.cascade_delete(channels, videos, chapters, channels.where("n_regionkey = 1").select("id"))
    named = [rows.select(F.lit(kind).alias("kind"), "id") for kind, rows in zip(("channel", "video", "chapter"), left, strict=True)]
    return named[0].unionByName(named[1]).unionByName(named[2])


# S-30, F-25
@query("""WITH e AS (SELECT p_partkey, p_size, 100 + p_size * 3 - p_size % 7 AS width, p_size + 41 AS height FROM part)
SELECT p_partkey AS video, p_size AS track, width, height, floor((640 - width) / 2.0)::INT AS "left", (640 - width - floor((640 - width) / 2.0))::INT AS "right",
  floor((361 - height) / 2.0)::INT AS top, (361 - height - floor((361 - height) / 2.0))::INT AS bottom FROM e""")
def q54_crops(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video"), F.col("p_size").alias("track"))
    low = F.col("track") % 7
    boxes = rows.select("video", "track", low.alias("min_w"), (F.lit(100) + F.col("track") * 3).alias("max_w"), F.lit(3).alias("min_h"), (F.col("track") + 44).alias("max_h"))
    found = manifests.crops(rows, boxes)
    borders = manifests.padding(F.lit(640), F.lit(361), F.col("width"), F.col("height"))
    return found.select("video", "track", "width", "height", *[x.alias(n) for x, n in zip(borders, ("left", "right", "top", "bottom"), strict=True)])


# P-20
@query(f"""WITH q AS ({sequences.ORACLE_SQL["q19_segment_compare"]})
SELECT 'differs' AS kind, video, mean_distance FROM q WHERE NOT isnan(mean_distance) AND mean_distance <> 0 UNION ALL SELECT 'unlike', video, NULL FROM q WHERE isnan(mean_distance)""")
def q55_split_comparison(spark, sf_dir):
    kinds = sequences.q19_segment_compare(spark, sf_dir).withColumn("kind", segments.comparison_kind()).where("kind IS NOT NULL")
    return kinds.select("kind", "video", F.when(F.col("kind") == "differs", F.col("mean_distance")).alias("mean_distance"))


# J-13
@query("""SELECT user_id, 'f' || event_id AS filename, event_type AS video_id, value AS segments FROM events""")
def q56_catalogue(spark, sf_dir):
    row = F.array_sort(F.collect_list(F.struct("event_id", "event_type", "value")))
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(row.alias("r"))
    names = F.transform("r", lambda x: F.concat(F.lit("f"), x["event_id"].cast("string")))
    zipped = segments.catalogue(names, F.transform("r", lambda x: x["event_type"]), F.transform("r", lambda x: x["value"]))
    return lists.select("user_id", F.inline(zipped))


# F-07, F-08, F-12, F-13, F-14, F-21, S-15
@query(r"""WITH p AS (SELECT page_id, url, 'data/set' || page_id % 5 || '/pose' || page_id || '.txt' AS path FROM pages)
SELECT page_id, '@' || regexp_replace(regexp_extract(url, '[^/]*$'), '\.[^.]*$', '') AS channel, 'Mpose' || page_id || '.txt' AS mirrored,
  'out/set' || page_id % 5 || '/pose' || page_id || '.npy' AS array_path, 'pose' || page_id || '.txt' AS dataset, page_id::INT AS frame,
  page_id::DOUBLE / nullif(page_id % 4, 0) AS fps FROM p""")
def q57_paths(spark, sf_dir):
    number = F.col("page_id").cast("string")
    path = F.concat(F.lit("data/set"), (F.col("page_id") % 5).cast("string"), F.lit("/pose"), number, F.lit(".txt"))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.channel_id(text.stem(text.file_name(F.col("url")))).alias("channel"), text.mirrored_name(text.file_name(path)).alias("mirrored"),
        text.array_path(path, "data/", "out/").alias("array_path"), text.dataset_of(path).alias("dataset"), text.frame_number(F.concat(number, F.lit(".jpg"))).alias("frame"),
        text.frame_rate(F.concat(number, F.lit("/"), (F.col("page_id") % 4).cast("string"))).alias("fps"),
    )


# P-06, S-13, F-20, F-23, F-24, F-30
@query("""SELECT l_orderkey, l_linenumber, greatest(l_quantity * 10, l_partkey % 500) > 360 AS large, l_extendedprice / nullif(l_quantity - 1, 0) AS seconds,
  least(greatest(l_extendedprice, 1000.0), 30000.0)::DOUBLE AS clipped, round(sqrt(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount), 6) AS length,
  l_quantity AS x, l_discount AS y, l_tax AS z FROM lineitem""")
def q58_sizes(spark, sf_dir):
    vector = tuple(F.col(c) for c in ("l_quantity", "l_tax", "l_discount"))
    x, y, z = geometry.swap_yz(vector)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", manifests.large_enough(F.col("l_quantity") * 10, F.col("l_partkey") % 500).alias("large"),
        manifests.video_length(F.col("l_extendedprice"), F.col("l_quantity") - 1).alias("seconds"), geometry.clip(F.col("l_extendedprice"), 1000.0, 30000.0).cast("double").alias("clipped"),
        F.round(geometry.norm(vector), 6).alias("length"), x.alias("x"), y.alias("y"), z.alias("z"),
    )


# X-16
@query("""WITH t(token) AS (VALUES ('bolt'), ('gear'))
SELECT token, 'https://youtu.be/' || p_partkey || '?start=' || p_size || '&end=' || (p_size + 9) AS link FROM t JOIN part ON p_name ILIKE '%' || token || '%' AND NOT p_name ILIKE '%small%'""")
def q59_prompt_links(spark, sf_dir):
    chapters = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_id"), F.col("p_name").alias("title"), F.col("p_size").alias("start_time"), (F.col("p_size") + 9).alias("end_time"))
    return prompts.links_from_prompt(chapters, prompts.Prompt(or_tokens=("bolt", "gear"), and_not_tokens=("small",)))


# J-07
@query("""SELECT c_custkey, o_orderkey, true AS skipped FROM customer JOIN orders ON o_custkey = c_custkey UNION ALL SELECT c_custkey, o_orderkey, false FROM customer LEFT JOIN orders ON o_custkey = c_custkey""")
def q60_with_joints(spark, sf_dir):
    videos = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("clip"), F.col("c_custkey").cast("string")).alias("stem"))
    joints = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("clip"), F.col("o_custkey").cast("string")).alias("stem"))
    both = [manifests.with_joints(videos, joints, skip).withColumn("skipped", F.lit(skip)).drop("stem") for skip in (True, False)]
    return both[0].unionByName(both[1])


# A-20, V-23
@query("""WITH b AS (SELECT event_id, event_id % 9 AS x, user_id % 7 AS y FROM events), c AS (SELECT k % 16 AS cx, k // 16 AS cy FROM range(0, 192) t(k))
SELECT event_id, count(*)::INT AS covered FROM b, c WHERE (cx BETWEEN x AND x + 4 AND cy BETWEEN y AND y + 2) OR (cx BETWEEN 6 AND 9 AND cy BETWEEN y - 1 AND y + 5) GROUP BY 1""")
def q61_mask_union(spark, sf_dir):
    x, y = F.col("event_id") % 9, F.col("user_id") % 7
    boxes = F.array(F.array(x, y, x + 4, y + 2), F.array(F.lit(6).cast("long"), y - 1, F.lit(9).cast("long"), y + 5))
    images = table(spark, sf_dir, "events").select("event_id", F.lit(16).alias("width"), F.lit(12).alias("height"), boxes.alias("boxes"))
    return registration.covered(images).select("event_id", "covered")


# F-26, F-27
@query("""SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '"}' AS document, CASE WHEN event_id % 3 = 2 THEN event_id ELSE -1 END AS third FROM events""")
def q62_json_and_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    values = F.sequence(F.lit(0).cast("long"), F.col("event_id") % 3)
    third = F.when(ingest.of_length(values, 3).isNotNull(), F.col("event_id")).otherwise(-1)
    return rows.select("event_id", ingest.json_text("event_id", "event_type").alias("document"), third.alias("third"))


# W-17
@query(f"""WITH {sequences.BASE}, q AS (SELECT video, frame, value - 50 AS w, (frame % 3 - 1)::DOUBLE AS x, value / 10 - 3 AS y, 1.0::DOUBLE AS z FROM fr),
f AS (SELECT *, CASE WHEN w * lag(w) OVER o + x * lag(x) OVER o + y * lag(y) OVER o + z * lag(z) OVER o < 0 THEN 1 ELSE 0 END AS flip FROM q WINDOW o AS (PARTITION BY video ORDER BY frame)),
s AS (SELECT *, CASE WHEN sum(flip) OVER (PARTITION BY video ORDER BY frame) % 2 = 1 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sign FROM f)
SELECT video, frame, round(w * sign, 6) + 0 AS w, round(x * sign, 6) + 0 AS x, round(y * sign, 6) + 0 AS y, round(z * sign, 6) + 0 AS z FROM s""")
def q63_quaternion_continuity(spark, sf_dir):
    rows = sequences.frames(spark, sf_dir)
    parts = [F.col("value") - 50, (F.col("frame") % 3 - 1).cast("double"), F.col("value") / 10 - 3, F.lit(1.0)]
    turned = sequence.continuous(rows.withColumn("q", F.array(*parts)), "q")
    return turned.select("video", "frame", *[(F.round(F.get("q", k), 6) + 0).alias(c) for k, c in enumerate("wxyz")])


# O-05
@query("""SELECT n_name AS name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) - 1 AS place, n_regionkey AS folder FROM nation""")
def q64_listing_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.in_name_order(table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("folder")), "folder", "name")
