"""Connected components of an edge table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges(a, b)``; component is the smallest node reachable.

    Alternates large-star and small-star steps, which keep the components and shorten every
    path, until nothing changes. Each round is written to the shared folder and the round before
    it is removed. A hub costs one row per neighbour and no pairs: the nodes' minima are summed on the
    map side and written, and both sides of the joins that bring them back are tables, so that
    a hub's neighbours are split over tasks. Edges with a null end are ignored; no edges, no rows.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")))
        large = stored(both.filter("b > a").join(low.hint("merge"), "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")))
        discard(low)
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low)
        last, edges = edges, stored(small.distinct())
        for x in (last, large, low):
            discard(x)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.union(edges.select("b", "b").distinct()).toDF("node", "component")
        seen = state
