"""Queries of segments, tracks and sequences over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import manifests, registration, segments, sequence, tracks
from .relational import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


SIZE = 5

#: CTEs: frames of a user's events, batches of five, pairs of batches, videos.
BASE = """fr AS (SELECT user_id AS video, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, value FROM events),
ba AS (SELECT video, frame // 5 AS batch, floor(round(avg(value), 6))::BIGINT AS mean_value, count(*) AS n_frames FROM fr GROUP BY 1, 2),
pa AS (SELECT * FROM (SELECT video, row_number() OVER (PARTITION BY video ORDER BY batch) - 2 AS pair_idx, mean_value - lag(mean_value) OVER (PARTITION BY video ORDER BY batch) AS delta FROM ba) WHERE pair_idx >= 0),
re AS (SELECT video, pair_idx, delta AS dx, pair_idx % 3 AS dy, (pair_idx * 7 % 10) / 10.0::DOUBLE AS confidence FROM pa),
vi AS (SELECT video, count(*) AS frames_number FROM fr GROUP BY 1)"""


def steady_sql(limit: int, name: str) -> str:
    """CTEs ending in `name` (video, start, end, seg_idx): bins, union, duration, combination."""
    n = name
    return f"""{n}b AS (SELECT re.video, pair_idx * 5 AS s, CASE WHEN pair_idx = max(pair_idx) OVER (PARTITION BY re.video) THEN frames_number - 1 ELSE (pair_idx + 2) * 5 - 1 END AS e,
  sqrt(dx * dx + dy * dy) < {limit} AND confidence > 0.05 AS ok FROM re JOIN vi USING (video)),
{n}f AS (SELECT video, s, e, CASE WHEN lag(e) OVER w > s THEN 0 ELSE 1 END AS new FROM {n}b WHERE ok WINDOW w AS (PARTITION BY video ORDER BY s, e)),
{n}g AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {n}f),
{n}u AS (SELECT video, min(s) AS s, arg_max(e, s) AS e FROM {n}g GROUP BY video, run HAVING (arg_max(e, s) - min(s)) / 5.0 >= 2),
{n}h AS (SELECT video, s, e, CASE WHEN lag(e) OVER w + 1 = s THEN 0 ELSE 1 END AS new FROM {n}u WINDOW w AS (PARTITION BY video ORDER BY s, e)),
{n}i AS (SELECT *, sum(new) OVER (PARTITION BY video ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM {n}h),
{n}c AS (SELECT video, min(s)::BIGINT AS start, arg_max(e, s)::BIGINT AS "end" FROM {n}i GROUP BY video, run),
{n} AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start) - 1 AS seg_idx FROM {n}c)"""


def frames(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video"), "ts", "event_id", "value")
    return sequence.frame_index(rows, "video", "ts", "event_id")


def pairs(spark, sf_dir) -> DataFrame:
    return sequence.pair_deltas(sequence.batch_means(frames(spark, sf_dir), "value", SIZE))


def registered(spark, sf_dir) -> DataFrame:
    i = F.col("pair_idx")
    return pairs(spark, sf_dir).select("video", "pair_idx", F.col("delta").alias("dx"), (i % 3).alias("dy"), ((i * 7 % 10) / F.lit(10.0)).alias("confidence"))


def videos(spark, sf_dir) -> DataFrame:
    counts = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("video")).agg(F.count(F.lit(1)).alias("frames_number"))
    return counts.withColumns({"fps": F.lit(5.0), "filename": F.concat(F.lit("clip."), F.col("video").cast("string"), F.lit(".mp4"))})


def steady(spark, sf_dir, limit: int = 25) -> DataFrame:
    return segments.steady_segments(registered(spark, sf_dir), videos(spark, sf_dir), SIZE, limit, 0.05, 2.0)


# S-14, A-11
@query(f"WITH {BASE} SELECT video, batch, mean_value, n_frames FROM ba")
def q08_batch_mean(spark, sf_dir):
    return sequence.batch_means(frames(spark, sf_dir), "value", SIZE)


# W-01, P-10
@query(f"WITH {BASE} SELECT video, pair_idx, dx AS delta, sqrt(dx * dx + dy * dy) < 20 AND confidence > 0.2 AS is_steady FROM re")
def q09_pair_delta(spark, sf_dir):
    ok = segments.steady(F.col("dx"), F.col("dy"), F.col("confidence"), 20, 0.2)
    return registered(spark, sf_dir).select("video", "pair_idx", F.col("dx").alias("delta"), ok.alias("is_steady"))


# W-02, W-03, P-09, W-04, X-05
@query(f"""WITH {BASE}, {steady_sql(25, "st")} SELECT video, start, "end", seg_idx FROM st""")
def q10_steady_segments(spark, sf_dir):
    return steady(spark, sf_dir).select("video", "start", "end", "seg_idx")


GAPS = """ed AS (SELECT video, 0 AS kind, 0 AS s, 0 AS e FROM vi UNION ALL SELECT video, 2, frames_number - 1, frames_number - 1 FROM vi UNION ALL SELECT video, 1, start, "end" FROM st),
ga AS (SELECT video, kind, e AS f, lead(s) OVER w AS t, lead(kind) OVER w AS nk FROM ed WINDOW w AS (PARTITION BY video ORDER BY kind, s)),
co AS (SELECT video, f::BIGINT AS start, t::BIGINT AS "end" FROM ga WHERE t IS NOT NULL AND NOT ((kind = 0 OR nk = 2) AND f = t))"""


# W-05
@query(f"""WITH {BASE}, {steady_sql(25, "st")}, {GAPS} SELECT * FROM co""")
def q11_complement(spark, sf_dir):
    return segments.complement(steady(spark, sf_dir), videos(spark, sf_dir))


# X-06
@query(f"""WITH {BASE}, {steady_sql(25, "st")}, {GAPS}
SELECT *, row_number() OVER (PARTITION BY video ORDER BY start) - 1 AS seg_idx FROM co WHERE ("end" - start) / 5.0 >= 2""")
def q11b_non_steady(spark, sf_dir):
    return segments.non_steady_segments(steady(spark, sf_dir), videos(spark, sf_dir)).select("video", "start", "end", "seg_idx")


# W-06
@query(f"""WITH {BASE}, {steady_sql(60, "st")}
SELECT video, count(*) = 1 AND min(start) = 0 AND max("end") = any_value(frames_number) - 1 AS is_whole FROM st JOIN vi USING (video) GROUP BY 1""")
def q12_whole_range(spark, sf_dir):
    return segments.whole_range(steady(spark, sf_dir, 60), videos(spark, sf_dir))


# J-02, J-03, P-15
@query(f"""WITH {BASE}, {steady_sql(25, "st")},
tr AS (SELECT video, frame % 3 AS track, min(frame) AS first, max(frame) AS last FROM fr WHERE frame >= 4 + video % 7 GROUP BY 1, 2)
SELECT video, track, seg_idx, greatest(start, first) AS clip_start, least("end", last) AS clip_end FROM st JOIN tr USING (video)
WHERE least("end", last) > greatest(start, first) AND least("end", last) - greatest(start, first) > 12""")
def q13_clip_fragments(spark, sf_dir):
    rows = frames(spark, sf_dir).where(F.col("frame") >= 4 + F.col("video") % 7).withColumn("track", F.col("frame") % 3)
    found = segments.clip_to(steady(spark, sf_dir), tracks.extents(rows), 12)
    return found.select("video", "track", "seg_idx", "clip_start", "clip_end")


#: Tracks: a user is a track, a day a frame.
TRACKS = """tk AS (SELECT DISTINCT user_id % 10 AS video, user_id AS track, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS frame FROM events),
cf AS (SELECT user_id % 10 AS video, user_id AS track, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS frame, least(1.0::DOUBLE, max(value) / 40) AS c FROM events GROUP BY 1, 2, 3),
ex AS (SELECT video, track, count(*) AS n, min(frame) AS first, max(frame) AS last FROM tk GROUP BY 1, 2),
sb AS (SELECT video, track, n, first, last FROM ex WHERE n > 10 AND n / nullif(last - first, 0)::DOUBLE > 0.95),
cr AS (SELECT video, track, round(sum(c) / (max(frame) - min(frame) + 1), 6) AS credibility FROM cf GROUP BY 1, 2),
cm AS (SELECT a.video, a.track AS a, b.track AS b, count(*) AS k FROM tk a JOIN tk b ON a.video = b.video AND a.frame = b.frame AND a.track <> b.track GROUP BY 1, 2, 3),
ov AS (SELECT cm.video, cm.a AS track, cm.b AS other, round(k / n::DOUBLE, 6) AS overlap FROM cm JOIN ex ON ex.video = cm.video AND ex.track = cm.a),
sp AS (SELECT video, track FROM ex WHERE (video, track) NOT IN (SELECT (video, track) FROM ov WHERE overlap > 0.97))"""


def daily(spark, sf_dir) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("video"), F.col("user_id").alias("track"), day.alias("frame"), "value")
    return rows.groupBy("video", "track", "frame").agg(F.least(F.lit(1.0), F.max("value") / 40).alias("c"))


def q14(spark, sf_dir):
    return tracks.stable(tracks.extents(daily(spark, sf_dir)), 10)


def q15(spark, sf_dir):
    scored = tracks.credibility(daily(spark, sf_dir), F.col("c"), points=1)
    return tracks.credible(scored.withColumn("credibility", F.round("credibility", 6)), 0.85)


# A-05, P-11, P-12
@query(f"WITH {TRACKS} SELECT * FROM sb")
def q14_stable_tracks(spark, sf_dir):
    return q14(spark, sf_dir)


# A-06, P-13
@query(f"WITH {TRACKS} SELECT * FROM cr WHERE credibility > 0.85")
def q15_credibility(spark, sf_dir):
    return q15(spark, sf_dir)


# J-04, A-07, U-05
@query(f"WITH {TRACKS} SELECT * FROM ov")
def q16_pair_overlap(spark, sf_dir):
    # the SQL's round(); Spark's makes a decimal of each of very many rows
    return tracks.overlaps(daily(spark, sf_dir)).withColumn("overlap", F.floor(F.col("overlap") * 1e6 + 0.5) / 1e6)


# P-14, U-03
@query(f"WITH {TRACKS} SELECT * FROM sp")
def q16b_single_person(spark, sf_dir):
    return tracks.single_person(daily(spark, sf_dir), 0.97)


# U-07, A-08
@query(f"""WITH {TRACKS} SELECT video, track, count(*) AS votes FROM (SELECT video, track FROM sb UNION ALL SELECT video, track FROM cr WHERE credibility > 0.85 UNION ALL SELECT video, track FROM sp)
GROUP BY 1, 2 HAVING count(*) >= 2""")
def q17_vote(spark, sf_dir):
    return tracks.vote(q14(spark, sf_dir), q15(spark, sf_dir), tracks.single_person(daily(spark, sf_dir), 0.97))


# X-18
@query(f"""WITH {TRACKS}, al AS (SELECT track AS video, track, n, first, last FROM ex)
SELECT * FROM al WHERE n > 12 AND n / nullif(last - first, 0)::DOUBLE > 0.9""")
def q17b_only_track(spark, sf_dir):
    rows = daily(spark, sf_dir).withColumn("video", F.col("track"))
    return tracks.only_track(rows, 12, 0.9)


# J-09, K-09
@query(f"WITH {TRACKS} SELECT ex.video, ex.track FROM ex WHERE video IN (SELECT video FROM sb)")
def q17c_crop_targets(spark, sf_dir):
    every = tracks.extents(daily(spark, sf_dir)).select("video", "track")
    return tracks.tracks_to_crop(every, q14(spark, sf_dir), compat=True)


# A-09, A-10
@query("""SELECT l_orderkey, trunc(min(l_discount * 1000))::INT AS min_h, trunc(greatest(max(l_tax * 1000), 0.0))::INT AS max_h, trunc(min(l_quantity))::INT AS min_w,
  trunc(greatest(max(l_extendedprice), 0.0))::INT AS max_w, max(l_tax * 1000 - l_discount * 1000) + 2 AS max_height, max(l_extendedprice - l_quantity) + 2 AS max_width FROM lineitem GROUP BY 1""")
def q18_envelope(spark, sf_dir):
    box = F.array(F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_extendedprice"), F.col("l_tax") * 1000)
    rows = table(spark, sf_dir, "lineitem")
    return tracks.envelope(rows, box, ("l_orderkey",)).join(tracks.max_size(rows, box, ("l_orderkey",)), "l_orderkey")


# J-14, O-03
@query("""SELECT l_orderkey, trunc(l_extendedprice / 100)::SMALLINT AS x FROM
  (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS n FROM lineitem WHERE l_suppkey % 2 = 0) WHERE n = 1""")
def q18b_own_box(spark, sf_dir):
    box = F.array(F.col("l_extendedprice") / 100, F.lit(0.0), F.lit(0.0), F.lit(0.0), (F.col("l_suppkey") % 2).cast("double"))
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", box.alias("b")))), lambda s: s["b"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(boxes.alias("boxes"))
    return rows.withColumn("own", tracks.own_box(F.col("boxes"), F.lit(0.0))).where("own IS NOT NULL").select("l_orderkey", F.col("own")[0].alias("x"))


# J-05, J-06, A-12
@query(f"""WITH {BASE}, {steady_sql(25, "st")}, {steady_sql(28, "su")},
n AS (SELECT a.video, a.n AS n_a, b.n AS n_b FROM (SELECT video, count(*) AS n FROM st GROUP BY 1) a JOIN (SELECT video, count(*) AS n FROM su GROUP BY 1) b USING (video)),
d AS (SELECT st.video, unnest([abs(st.start - su.start), abs(st."end" - su."end")]) AS d FROM st JOIN su USING (video, seg_idx)),
s AS (SELECT video, avg(d) AS m, stddev_pop(d) AS sd FROM d GROUP BY 1)
SELECT n.video, n_a, n_b, CASE WHEN n_a = n_b THEN round(m, 6) ELSE 'nan'::DOUBLE END AS mean_distance, CASE WHEN n_a = n_b THEN round(sd, 6) ELSE 'nan'::DOUBLE END AS std_distance FROM n LEFT JOIN s USING (video)""")
def q19_segment_compare(spark, sf_dir):
    found = segments.compare_runs(segments.steady_runs(registered(spark, sf_dir), videos(spark, sf_dir), (25, 28), frames=SIZE, min_confidence=0.05, min_seconds=2.0))
    return found.withColumns({c: F.round(c, 6) for c in ("mean_distance", "std_distance")})


CURVE = "SELECT user_id % 20 AS curve, date_diff('day', TIMESTAMP '2024-01-01', ts)::BIGINT AS frame, round(sum(value), 4) AS v FROM events GROUP BY 1, 2"


def curves(spark, sf_dir) -> DataFrame:
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("curve"), day.alias("frame")).agg(F.round(F.sum("value"), 4).alias("v"))


# W-13, W-14
@query(f"""WITH c AS ({CURVE}) SELECT curve, frame, round(coalesce(sum(v) OVER (PARTITION BY curve ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 3) AS total,
  round(v - first_value(v) OVER (PARTITION BY curve ORDER BY frame), 3) AS v FROM c""")
def q33_cumsum_root(spark, sf_dir):
    summed = sequence.running_sum(curves(spark, sf_dir), "v", key="curve")
    return sequence.rebased(summed, "v", key="curve").select("curve", "frame", F.round("total", 3).alias("total"), F.round("v", 3).alias("v"))


# W-07
@query(f"""WITH c AS ({CURVE}), l AS (SELECT abs(v - lead(v, 3) OVER (PARTITION BY curve ORDER BY frame)) * (1.0::DOUBLE / (1 + curve)) AS g FROM c) SELECT round(avg(g), 4) AS difference FROM l""")
def q34_autocorr(spark, sf_dir):
    return sequence.lag_difference(curves(spark, sf_dir), "v", 3, F.lit(1.0) / (1 + F.col("curve"))).select(F.round("difference", 4).alias("difference"))


_G = sequence.gaussian_weights()
_REFLECT = f"""c AS ({CURVE}), i AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY curve) AS n FROM c),
k AS (SELECT i.curve, i.frame, i.i, i.n, o.o, ((i.i + o.o) % (2 * i.n) + 2 * i.n) % (2 * i.n) AS p FROM i, (SELECT unnest(range(-9, 10)) AS o) o)"""


# W-09
@query(f"""WITH {_REFLECT} SELECT k.curve, k.frame, round(sum(s.v * ([{", ".join(repr(x) for x in _G)}])[k.o + 10]), 4) AS smooth
FROM k JOIN i s ON s.curve = k.curve AND s.i = CASE WHEN k.p < k.n THEN k.p ELSE 2 * k.n - 1 - k.p END GROUP BY 1, 2""")
def q35_smooth(spark, sf_dir):
    return sequence.gaussian_smooth(curves(spark, sf_dir), "v").select("curve", "frame", F.round("smooth", 4).alias("smooth"))


# W-10
@query(f"""WITH c AS ({CURVE}), i AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY curve) AS n FROM c),
k AS (SELECT i.curve, i.frame, i.i + o.o AS p FROM i, (SELECT unnest(range(-15, 16)) AS o) o)
SELECT k.curve, k.frame, round(median(coalesce(s.v, 0)), 4) AS smooth FROM k LEFT JOIN i s ON s.curve = k.curve AND s.i = k.p GROUP BY 1, 2""")
def q35b_median(spark, sf_dir):
    return sequence.median_filter(curves(spark, sf_dir), "v").select("curve", "frame", F.round("smooth", 4).alias("smooth"))


# W-15, W-16, P-27, A-17
@query(f"""WITH c AS ({CURVE}), z AS (SELECT curve, frame, v - avg(v) OVER (PARTITION BY curve) AS v FROM c), s AS (SELECT curve, stddev_pop(v) AS std FROM z GROUP BY 1),
l AS (SELECT * FROM s WHERE std > (SELECT quantile_cont(std, 0.5) FROM s)), b AS (SELECT min(std) AS lo, max(std) AS hi FROM l)
SELECT curve, round(std, 4) AS std, round((((std - lo) / greatest(hi - lo, 0.01)) * 0.9 + 0.2) / 1.2, 6) AS colour FROM l, b""")
def q36_curve_mask(spark, sf_dir):
    lively = sequence.lively_curves(sequence.centred(curves(spark, sf_dir), "v"), "v")
    return sequence.colours(lively).select("curve", F.round("std", 4).alias("std"), F.round("colour", 6).alias("colour"))


# W-16
@query(f"""WITH c AS ({CURVE}), s AS (SELECT curve, stddev_pop(v) AS std FROM c GROUP BY 1) SELECT frame, round(avg(v * std), 2) AS mean_curve FROM c JOIN s USING (curve) GROUP BY 1""")
def q36b_mean_curve(spark, sf_dir):
    return sequence.weighted_mean_curve(curves(spark, sf_dir), "v").select("frame", F.round("mean_curve", 2).alias("mean_curve"))


# V-21, F-22
@query("""WITH e AS (SELECT event_id, event_id % 64 AS i, 100 + event_id % 900 AS w, 80 + event_id % 700 AS h FROM events)
SELECT event_id, CASE WHEN i > 32 THEN 63 - i ELSE i END AS shift, floor(w * (512.0::DOUBLE / greatest(w, h)) + 0.5)::INT AS width, floor(h * (512.0::DOUBLE / greatest(w, h)) + 0.5)::INT AS height, greatest(w, h) > 360 AS large FROM e""")
def q37_shift_wrap(spark, sf_dir):
    w, h, i = 100 + F.col("event_id") % 900, 80 + F.col("event_id") % 700, F.col("event_id") % 64
    width, height = registration.scaled_size(w, h, 512)
    return table(spark, sf_dir, "events").select("event_id", registration.wrapped(i, F.lit(64)).alias("shift"), width.alias("width"), height.alias("height"), manifests.large_enough(w, h).alias("large"))


# W-19, O-01
@query("SELECT n_name, (row_number() OVER (ORDER BY n_name) - 1) // 6 AS grid_row, (row_number() OVER (ORDER BY n_name) - 1) % 6 AS grid_column FROM nation")
def q38_grid(spark, sf_dir):
    return sequence.grid(table(spark, sf_dir, "nation").select("n_name"), "n_name")


# P-25, P-26, F-21
@query(f"""WITH {BASE}, l AS (SELECT *, trunc(CASE video % 3 WHEN 0 THEN 0.1 WHEN 1 THEN 0.05 ELSE 0 END * 40)::INT AS lead FROM fr)
SELECT video, frame FROM l WHERE frame >= lead + 2 AND frame < lead + 30 AND frame % greatest(1, trunc((60 + 60 * (video % 2)) / 40.0)::INT) = 0""")
def q39_lead_trim(spark, sf_dir):
    v = F.col("video")
    seconds = F.when(v % 3 == 0, 0.1).when(v % 3 == 1, 0.05).otherwise(0.0)
    cut = sequence.lead_trim(frames(spark, sf_dir), seconds, F.lit(2), F.lit(30))
    return sequence.down_sample(cut, 60 + 60 * (v % 2)).select("video", "frame")


# S-28, S-29, F-09, F-20
@query(f"""WITH {BASE}, {steady_sql(25, "st")}
SELECT video, start, "end", 'clip.' || video || '__steady_' || lpad(start::VARCHAR, 5, '0') || '-' || lpad("end"::VARCHAR, 5, '0') || '__.mp4' AS path,
  CASE WHEN start = 0 AND "end" = frames_number - 1 THEN 'copy' ELSE 'cut' END AS mode, start / 5.0::DOUBLE AS start_seconds, "end" / 5.0::DOUBLE AS end_seconds FROM st JOIN vi USING (video)""")
def q40_manifest(spark, sf_dir):
    return manifests.clips(steady(spark, sf_dir), videos(spark, sf_dir), "steady")


# P-17, P-18
@query("SELECT event_id, round(value / 100, 6) AS conf FROM events WHERE value / 100 > 0.7 AND event_id % 4 = 0")
def q44_detections(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 100).alias("conf"), (F.col("event_id") % 4).alias("cls"))
    return tracks.detections(rows, 0.7).select("event_id", F.round("conf", 6).alias("conf"))


# V-17..V-20, X-04
@query()
def q42_registration(spark, sf_dir):
    """Shifted images made from the frames' numbers: shifts and confidences per pair."""
    pixel = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: (F.pmod(F.hash((k % 16 + F.col("batch") * 2) % 16, F.floor(k / 16), F.col("video")), F.lit(256))).cast("double"))
    images = sequence.batch_means(frames(spark, sf_dir), "value", SIZE).select("video", "batch", F.lit(16).alias("height"), F.lit(16).alias("width"), pixel.alias("pixels"))
    return registration.register(images).withColumn("confidence", F.round("confidence", 6))


def sql_polynomial(window: int) -> str:
    """The list of lists of weights: by the row's place in its window, then by the place of the value."""
    return str([[float(x) for x in row] for row in sequence.polynomial_weights(window)])


# W-08
@query(f"""WITH c AS ({CURVE}), i AS (SELECT *, row_number() OVER (PARTITION BY curve ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY curve) AS n FROM c),
k AS (SELECT i.curve, i.frame, i.i, least(greatest(i.i - 7, 0), i.n - 15) AS low, o.o FROM i, (SELECT unnest(range(15)) AS o) o)
SELECT k.curve, k.frame, round(sum(s.v * ({sql_polynomial(15)})[k.i - k.low + 1][k.o + 1]), 4) AS smooth FROM k JOIN i s ON s.curve = k.curve AND s.i = k.low + k.o GROUP BY 1, 2""")
def q35c_polynomial(spark, sf_dir):
    return sequence.polynomial_smooth(curves(spark, sf_dir), "v", window=15).withColumn("smooth", F.round("smooth", 4))
