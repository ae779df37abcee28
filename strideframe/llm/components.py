"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WorkTables


def components(edges: DataFrame, tables: WorkTables) -> DataFrame:
    """Columns node, root (the smallest node reachable), for every node of edges (a, b).

    A round points each node at its smallest neighbour, follows pointers by
    doubling until they rest, and replaces the ends of every edge by their
    roots. Edges inside a component vanish, so rounds are logarithmic, as are
    the doublings. No task holds a neighbourhood: minima are aggregated before
    the exchange, and joins bring one row per node to the edges. Self edges
    and repeated edges do no harm; no edges give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    rest = tables.save(edges.select(low.alias("a"), high.alias("b")).distinct(), "edges")
    labels = None
    while labels is None or not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min("b").alias("m"))
        points = tables.save(near.select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "points")
        while True:
            ahead = points.select(F.col("node").alias("root"), F.col("root").alias("next"))
            moved = tables.save(points.join(ahead, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "points")
            done = moved.where("moved").isEmpty()
            tables.drop(points)
            points = moved
            if done:
                break
        ends = points.select("node", "root")
        a = ends.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = ends.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        cut = rest.join(a, "a").join(b, "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        left = tables.save(cut, "edges")
        if labels is None:
            labels = tables.save(ends, "labels")
        else:
            onward = ends.select(F.col("node").alias("root"), F.col("root").alias("top"))
            labels = tables.save(labels.join(onward, "root", "left").select("node", F.coalesce("top", "root").alias("root")), "labels")
        tables.drop(rest, points)
        rest = left
    return labels
