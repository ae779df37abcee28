"""Queries on images, masks and stacked clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import images, masks, numbering
from .relational import table
from .sequences import BASE, SIZE, frames

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _bytes(numbers: Column) -> Column:
    """An array of numbers below 256 as bytes."""
    return F.to_binary(F.array_join(F.transform(numbers, lambda p: F.lpad(F.hex(p), 2, "0")), ""), F.lit("hex"))


# V-23, A-20
@query("""WITH p AS (SELECT event_id, event_id % 9 AS x, user_id % 5 AS y FROM events),
e AS (SELECT event_id, unnest([{'a': x, 'b': y, 'c': x + 6, 'd': y + 1}, {'a': x + 6, 'b': y + 1, 'c': x + 4, 'd': y + 7}, {'a': x + 4, 'b': y + 7, 'c': x - 1, 'd': y + 4}, {'a': x - 1, 'b': y + 4, 'c': x, 'd': y},
  {'a': 3, 'b': 2, 'c': 11, 'd': 2, 't': 1}, {'a': 11, 'b': 2, 'c': 7, 'd': 10, 't': 1}, {'a': 7, 'b': 10, 'c': 3, 'd': 2, 't': 1}]) AS s FROM p),
m AS (SELECT event_id, coalesce(s.t, 0) AS shape, r AS cy, (s.c - s.a) * (r - s.b)::DOUBLE / (s.d - s.b) + s.a AS x FROM e, range(0, 12) t(r) WHERE r >= least(s.b, s.d) AND r < greatest(s.b, s.d)),
c AS (SELECT event_id, shape, cy, k AS cx FROM m, range(0, 16) t(k) WHERE k < x GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT event_id, coalesce(n, 0) AS covered FROM p LEFT JOIN (SELECT event_id, count(DISTINCT cy * 16 + cx) AS n FROM c GROUP BY 1) USING (event_id)""")
def q65_polygon_area(spark, sf_dir):
    """A quadrangle that differs from event to event, and a triangle."""
    x, y = (F.col("event_id") % 9).cast("double"), (F.col("user_id") % 5).cast("double")
    corners = lambda *ps: F.array(*(F.struct(F.lit(a).cast("double").alias("x"), F.lit(b).cast("double").alias("y")) for a, b in ps))
    shapes = F.array(corners((x, y), (x + 6, y + 1), (x + 4, y + 7), (x - 1, y + 4)), corners((3, 2), (11, 2), (7, 10)))
    spans = masks.polygon_spans(shapes, F.lit(12), F.lit(16))
    return table(spark, sf_dir, "events").select("event_id", masks.area(spans).alias("covered"))


# S-14, A-11
@query(f"""WITH {BASE}, px AS (SELECT video, frame // {SIZE} AS batch, frame, k, (floor(value)::BIGINT + frame * (k + 3) + video) % 256 AS p FROM fr, range(0, 12) t(k)),
me AS (SELECT video, batch, k, sum(p) // count(*) AS m, count(*) AS n_frames FROM px GROUP BY 1, 2, 3)
SELECT video, batch, max(n_frames) AS n_frames, sum((k + 1) * m)::BIGINT AS checksum FROM me GROUP BY 1, 2""")
def q66_batch_images(spark, sf_dir):
    """Mean images, by a checksum of their pixels."""
    pixel = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda k: F.pmod(F.floor("value") + F.col("frame") * (k + 3) + F.col("video"), F.lit(256)))
    shape = {"height": F.lit(3), "width": F.lit(4), "channels": F.lit(1)}
    found = images.batch_images(frames(spark, sf_dir).withColumn("pixels", _bytes(pixel)).withColumns(shape), SIZE)
    at = lambda k: (k + 1) * F.conv(F.substring(F.hex("pixels"), 2 * k + 1, 2), 16, 10).cast("long")
    return found.select("video", "batch", "n_frames", sum((at(k) for k in range(1, 12)), at(0)).alias("checksum"))


# X-04, S-14, A-11, A-20, V-17, V-18, V-19, V-22
@query()
def q67_frame_pairs(spark, sf_dir):
    """Frames of shifted patterns, each third batch with text and a person in it, as registered pairs."""
    pixel = F.transform(F.sequence(F.lit(0), F.lit(255)), lambda k: F.pmod(F.hash((k % 16 + F.floor(F.col("frame") / SIZE) * 2) % 16, F.floor(k / 16), F.col("video")), F.lit(256)))
    rows = frames(spark, sf_dir)
    shown = rows.withColumn("pixels", _bytes(pixel)).withColumns({"height": F.lit(16), "width": F.lit(16), "channels": F.lit(1)})
    box = lambda *b: F.array(F.array(*(F.lit(x) for x in b)))
    covers = rows.select("video", F.floor(F.col("frame") / SIZE).alias("batch")).where("batch % 3 = 0").distinct()
    covers = covers.select("video", "batch", masks.box_spans(box(1, 1, 6, 3), F.lit(16), F.lit(16)).alias("text"), masks.box_spans(box(9, 4, 14, 15), F.lit(16), F.lit(16)).alias("persons"))
    return images.register_frames(shown, covers, SIZE, most=None).withColumn("confidence", F.round("confidence", 6))


# U-02
@query("""WITH s AS (SELECT event_id, user_id AS clip, row_number() OVER (ORDER BY user_id, ts, event_id) - 1 AS row FROM events)
SELECT event_id, row, clip, row - min(row) OVER (PARTITION BY clip) AS frame FROM s""")
def q68_stack_clips(spark, sf_dir):
    """All videos' rows one below the other, cut apart again by the index alone."""
    clips = table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), "ts", "event_id")
    stacked, index = numbering.stack_clips(clips, "clip", ["ts", "event_id"])
    return numbering.cut_apart(stacked.select("event_id", "row"), index).select("event_id", "row", "clip", "frame")
