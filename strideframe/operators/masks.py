"""Masks as spans: struct(top, bottom, low, high), the columns low..high of the rows top..bottom, ends included (V-23, A-20).

All are expressions over arrays of one row: no pixel is made, and a mask costs
its corners and rows, not its area.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<top: int, bottom: int, low: int, high: int>>"


def _bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: a lambda evaluates what it closes over again for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _span(top: Column, bottom: Column, low: Column, high: Column, height: Column, width: Column) -> Column:
    """One span, cut to the image."""
    inside = lambda x, most: F.greatest(F.lit(0), F.least(x, most)).cast("int")
    none = F.lit(0)
    return F.struct(
        F.greatest(top, none).cast("int").alias("top"), F.least(bottom, height - 1).cast("int").alias("bottom"), inside(low, width).alias("low"), F.least(high, width - 1).cast("int").alias("high")
    )


def _full(spans: Column) -> Column:
    return F.filter(spans, lambda s: (s["top"] <= s["bottom"]) & (s["low"] <= s["high"])).cast(SPANS)


def box_spans(boxes: Column, height: Column, width: Column) -> Column:
    """Boxes (x1, y1, x2, y2), ends included; what is empty or outside is left out. Null boxes give no spans."""
    found = F.transform(boxes, lambda b: _span(b[1], b[3], b[0], b[2], height, width))
    return F.coalesce(_full(found), F.array().cast(SPANS))


def _polygon(points: Column, height: Column, width: Column) -> Column:
    edges = F.transform(points, lambda p, i: F.struct(p.alias("a"), F.get(points, (i + 1) % F.size(points)).alias("b")))
    first = F.greatest(F.lit(0), F.ceil(F.array_min(F.transform(points, lambda p: p["y"])))).cast("int")
    last = F.least(height - 1, F.ceil(F.array_max(F.transform(points, lambda p: p["y"]))) - 1).cast("int")

    def crossings(edges: Column, row: Column) -> Column:
        met = F.filter(edges, lambda e: (row >= F.least(e["a"]["y"], e["b"]["y"])) & (row < F.greatest(e["a"]["y"], e["b"]["y"])))
        return F.array_sort(F.transform(met, lambda e: (e["b"]["x"] - e["a"]["x"]) * (row - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))

    def spans(edges: Column, row: Column) -> Column:
        def paired(xs: Column) -> Column:
            ends = F.transform(xs, lambda x, i: F.when(i % 2 == 0, _span(row, row, F.ceil(x), F.ceil(F.get(xs, i + 1)) - 1, height, width)))
            return F.filter(ends, lambda s: s.isNotNull())

        return _bound(crossings(edges, row), paired)

    rows = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    return _bound(edges, lambda e: F.flatten(F.transform(rows, lambda row: spans(e, row))))


def polygon_spans(polygons: Column, height: Column, width: Column) -> Column:
    """Scan-line filling of polygons (arrays of struct(x, y)): points that an odd number of edges has to the right.

    A row counts from an edge's upper end, without its lower one. Null
    polygons, and those of no area, give no spans.
    """
    usable = F.filter(polygons, lambda p: F.coalesce(F.size(p), F.lit(0)) > 2)
    return F.coalesce(_full(F.flatten(F.transform(usable, lambda p: _polygon(p, height, width)))), F.array().cast(SPANS))


def _bands(spans: Column) -> Column:
    """(top, bottom) of the bands of rows over which the same spans lie."""
    cuts = F.array_sort(F.array_distinct(F.concat(F.transform(spans, lambda s: s["top"]), F.transform(spans, lambda s: s["bottom"] + 1))))
    both = _bound(cuts, lambda cuts: F.transform(cuts, lambda c, i: F.struct(c.alias("top"), (F.get(cuts, i + 1) - 1).alias("bottom"))))
    return F.filter(both, lambda b: b["bottom"].isNotNull())


def _within(spans: Column, top: Column) -> Column:
    met = F.filter(spans, lambda s: (s["top"] <= top) & (top <= s["bottom"]))
    return F.array_sort(F.transform(met, lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"))))


def united(spans: Column) -> Column:
    """A-20: spans that cover the same points, none of them twice; in order of rows and columns."""
    none = F.array().cast("array<struct<low: int, high: int>>")

    def merged(runs: Column, x: Column) -> Column:
        last = F.element_at(runs, -1)
        joined = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))))
        return F.when((F.size(runs) > 0) & (F.try_element_at(runs, F.lit(-1))["high"] >= x["low"] - 1), joined).otherwise(F.concat(runs, F.array(x)))

    def band(spans: Column, b: Column) -> Column:
        runs = F.aggregate(_within(spans, b["top"]), none, merged)
        return F.transform(runs, lambda r: F.struct(b["top"].alias("top"), b["bottom"].alias("bottom"), r["low"].alias("low"), r["high"].alias("high")))

    return _bound(spans, lambda spans: F.flatten(F.transform(_bands(spans), lambda b: band(spans, b)))).cast(SPANS)


def area(spans: Column) -> Column:
    """A-20: the number of points under the union of spans."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(-1).alias("upto"))

    def add(a: Column, x: Column) -> Column:
        fresh = F.greatest(F.lit(0), x["high"] - F.greatest(x["low"], a["upto"] + 1) + 1)
        return F.struct((a["total"] + fresh).alias("total"), F.greatest(a["upto"], x["high"]).alias("upto"))

    points = lambda spans, b: F.aggregate(_within(spans, b["top"]), start, add, lambda a: a["total"] * (b["bottom"] - b["top"] + 1))
    widths = _bound(spans, lambda spans: F.transform(_bands(spans), lambda b: points(spans, b)))
    return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)
