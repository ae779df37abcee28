"""URL filters by a temporal list join (operator 7).

Lists are dated changes: an entry (a host or a parent domain) is added to or
removed from a block or an allow list on a day. Changes become validity
intervals, from an addition to the next change of the same entry and list. The
intervals of a host and its parent domains are merged into one timeline per
host: consecutive segments, each with the verdict of the most specific entry
that is active, an allow entry before a block entry of the same length. The
as-of join lays the captures of a host and the starts of its segments in one
order of days and carries the last segment along, so that every row is looked
at once, whatever the number of segments.

Hosts are made distinct before lists are looked up, so a host with a third of
all captures costs one timeline. Its captures are dealt to as many keys as it
takes to leave none with more than one SHAREth of all captures, and its timeline
is copied to each. Only DataFrame functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

FOREVER = 2**31 - 1
#: A key has one SHAREth of all captures at most, so fewer than SHARE hosts are dealt to several keys.
SHARE = 300


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port, a leading "www." and a final dot; null where there is none."""
    place = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(place, r"^.*@", ""), r":[0-9]*$", ""), r"\.$", "")
    bare = F.regexp_replace(bare, r"^www\.", "")
    return F.when(bare != "", bare)


def validity(changes: DataFrame) -> DataFrame:
    """Intervals (entry, list, since, until) of changes (entry, list, day, action); until is excluded.

    Changes of one entry, list and day count once, a removal before an
    addition. Entries are compared in lower case; null entries, days, lists
    and actions are left out.
    """
    clean = changes.select(F.lower("entry").alias("entry"), "list", F.col("day").cast("int").alias("day"), "action").dropna()
    daily = clean.groupBy("entry", "list", "day").agg(F.max((F.col("action") == "add").cast("int")).alias("add"))
    until = F.lead("day").over(W.partitionBy("entry", "list").orderBy("day"))
    return daily.withColumn("until", F.coalesce(until, F.lit(FOREVER))).where("add = 1").select("entry", "list", F.col("day").alias("since"), "until")


def timelines(hosts: DataFrame, intervals: DataFrame) -> DataFrame:
    """Segments (host, since, until, entry, list) of each host, without overlap; days no entry covers have none.

    One sweep over a host's days: intervals of one entry and list have no
    overlap, so a day has one of each (number of labels, list) at most. Running
    last values keep, for each of these, the interval that began last; the most
    specific one that is still open wins. Numbers of labels that no entry has
    are left out: a row for each number is collected.
    """
    parts = F.split("host", r"\.")
    names = hosts.select("host", parts.alias("parts"), F.size(parts).alias("labels"))
    suffix = "transform(sequence(1, labels), i -> struct(labels - i + 1 AS labels, array_join(slice(parts, i, labels), '.') AS entry))"
    suffixes = names.select("host", F.explode(F.expr(suffix)).alias("x")).select("host", "x.labels", "x.entry")
    active = suffixes.join(intervals, "entry").withColumn("level", F.col("labels") * 2 + (F.col("list") == "allow").cast("int"))
    depths = intervals.select(F.size(F.split("entry", r"\.")).alias("n")).distinct().collect()
    levels = [2 * n + allow for n in sorted((r["n"] for r in depths), reverse=True) for allow in (1, 0)]
    if not levels:
        return active.select("host", "since", "until", "entry", "list")
    began, ended = F.struct("since", "until", "entry", "list"), F.lit(None).cast("struct<since:int,until:int,entry:string,list:string>")
    events = active.select("host", F.col("since").alias("day"), "level", began.alias("x")).unionByName(active.select("host", F.col("until").alias("day"), "level", ended.alias("x")))
    # one row for each day of a host on which anything changes
    days = events.groupBy("host", "day").agg(*[F.max(F.when(F.col("level") == k, F.col("x"))).alias(f"l{k}") for k in levels])
    line = W.partitionBy("host").orderBy("day")
    held = days.select("host", F.col("day").alias("since"), F.lead("day").over(line).alias("until"), *[F.last(f"l{k}", ignorenulls=True).over(line).alias(f"l{k}") for k in levels])
    best = F.coalesce(*[F.when(F.col(f"l{k}.until") > F.col("since"), F.col(f"l{k}")) for k in levels])
    return held.where("until IS NOT NULL").select("host", "since", "until", best.alias("x")).where("x IS NOT NULL").select("host", "since", "until", "x.entry", "x.list")


def filter_urls(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """captures (url, fetched: day number, further columns) with host, entry, list and blocked.

    A null, empty or unusable url, a null day, and a host without an active
    entry are not blocked; entry and list are null. Rows are neither lost nor
    repeated; equal ones get equal results. Columns of captures with these four
    names are replaced; no other name can clash. An empty table gives no rows.
    """
    own = ["host", "entry", "list", "blocked"]
    captures = captures.drop(*own)
    inner = [c if c in ("url", "fetched") else f"column_{k}" for k, c in enumerate(captures.columns)]
    kept = captures.toDF(*inner).withColumns({"host": host_of(F.col("url")), "__day": F.col("fetched").cast("int")})
    hosts = kept.where("host IS NOT NULL AND __day IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    line = timelines(hosts.select("host"), validity(changes))
    most = (hosts.agg(F.sum("n")).first()[0] or 0) / SHARE
    hot = hosts.where(F.col("n") > F.lit(most)).select("host", F.ceil(F.col("n") / F.lit(most or 1.0)).cast("int").alias("__keys"))
    keys = F.coalesce("__keys", F.lit(1))
    dealt = kept.where("host IS NOT NULL AND __day IS NOT NULL").join(F.broadcast(hot), "host", "left")
    dealt = dealt.withColumns({"__key": F.pmod(F.xxhash64("url", "__day", F.monotonically_increasing_id()), keys).cast("int"), "__row": F.lit(1)}).drop("__keys")
    copies = line.join(F.broadcast(hot), "host", "left").withColumn("__key", F.explode(F.sequence(F.lit(0), keys - 1)))
    copies = copies.select("host", "__key", F.col("since").alias("__day"), F.lit(0).alias("__row"), F.struct("until", "entry", "list").alias("__segment"))
    both = dealt.unionByName(copies, allowMissingColumns=True)
    ahead = W.partitionBy("host", "__key").orderBy("__day", "__row").rowsBetween(W.unboundedPreceding, 0)
    found = both.withColumn("__segment", F.last("__segment", ignorenulls=True).over(ahead)).where("__row = 1")
    hit = F.col("__segment.until") > F.col("__day")
    found = found.select(*inner, "host", F.when(hit, F.col("__segment.entry")).alias("entry"), F.when(hit, F.col("__segment.list")).alias("list"))
    none = kept.where("host IS NULL OR __day IS NULL").select(*inner, "host", F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("list"))
    out = found.unionByName(none).withColumn("blocked", F.coalesce(F.col("list") == "block", F.lit(False)))
    return out.select(*inner, *own).toDF(*captures.columns, *own)


def dated_changes(hosts: DataFrame) -> DataFrame:
    """Lists by a rule, for the query: a checksum of each host or parent decides list and days."""
    parts = F.split("host", r"\.")
    names = hosts.select(parts.alias("parts"))
    entry = names.select(F.explode(F.expr("transform(sequence(1, size(parts)), i -> array_join(slice(parts, i, size(parts)), '.'))")).alias("entry")).distinct()
    a = F.conv(F.substring(F.md5(F.col("entry").cast("binary")), 1, 4), 16, 10).cast("int")
    numbered = entry.where("instr(entry, '.') > 0").withColumn("a", a).where("a % 3 < 2")
    day = F.col("a") % 200
    gone = day + 30 + F.col("a") % 100
    rows = F.array(
        F.struct(day.alias("day"), F.lit("add").alias("action")),
        F.struct(gone.alias("day"), F.lit("remove").alias("action")),
        F.struct(F.when(F.col("a") % 2 == 0, gone + 20).alias("day"), F.lit("add").alias("action")),
    )
    return numbered.select("entry", F.when(F.col("a") % 3 == 0, "block").otherwise("allow").alias("list"), F.explode(rows).alias("x")).select("entry", "list", "x.day", "x.action").dropna()


def url_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, host, fetched, entry, list, blocked. A page's day is its id modulo 365."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    captures = pages.withColumn("fetched", F.pmod("page_id", F.lit(365)).cast("int"))
    changes = dated_changes(captures.select(host_of(F.col("url")).alias("host")).dropna().distinct())
    return filter_urls(captures, changes).select("page_id", "host", "fetched", "entry", "list", "blocked")


SQL = r"""
WITH p AS (
  SELECT page_id, CAST(((page_id % 365) + 365) % 365 AS INTEGER) AS fetched,
         nullif(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
           lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\\]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '\.$', ''), '^www\.', ''), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host FROM p WHERE host IS NOT NULL),
s AS (
  SELECT host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS entry
  FROM (SELECT host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM h)),
e AS (
  SELECT entry, ('0x' || substr(md5(entry), 1, 4))::INTEGER AS a
  FROM (SELECT DISTINCT entry FROM s WHERE contains(entry, '.'))),
c AS (
  SELECT entry, a % 3 AS k, a % 200 AS day, 1 AS plus FROM e WHERE a % 3 < 2
  UNION ALL SELECT entry, a % 3, a % 200 + 30 + a % 100, 0 FROM e WHERE a % 3 < 2
  UNION ALL SELECT entry, a % 3, a % 200 + 50 + a % 100, 1 FROM e WHERE a % 3 < 2 AND a % 2 = 0),
v AS (
  SELECT entry, k, day AS since, coalesce(lead(day) OVER (PARTITION BY entry, k ORDER BY day), 2147483647) AS until, plus FROM c),
m AS (
  SELECT p.page_id, max_by(v.entry, length(v.entry)) AS entry, max_by(v.k, length(v.entry)) AS k
  FROM p JOIN s USING (host) JOIN v ON v.entry = s.entry AND v.plus = 1 AND v.since <= p.fetched AND p.fetched < v.until
  GROUP BY p.page_id)
SELECT p.page_id, p.host, p.fetched, m.entry,
       CASE m.k WHEN 0 THEN 'block' WHEN 1 THEN 'allow' END AS list, coalesce(m.k = 0, false) AS blocked
FROM p LEFT JOIN m USING (page_id)
"""
