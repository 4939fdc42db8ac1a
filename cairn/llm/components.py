"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import drop_stash, stash


def _mark(edges: DataFrame) -> tuple:
    """The count and two order-free hashes that change when the edge set changes; none can overflow."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> one row per node that has an edge: node, root (the smallest node it reaches).

    Every step groups by node and keeps minima, which combine before the shuffle; stars around busy nodes are
    split by AQE's skew join. Each round is written to the shared folder, so lost executors cost one round.
    """
    e = stash(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Edges to a smaller neighbour that is already the minimum come from the other end.
        large = large.unionByName(least.filter("m < a").select("a", F.col("m").alias("b"))).distinct()
        large = stash(large, "cc")
        if _mark(large) == mark and large.select("a").distinct().count() == mark[0]:  # one smaller neighbour each, so stars
            drop_stash(large)
            break
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = stash(small, "cc")
        now = _mark(new)
        drop_stash(large)
        drop_stash(e)
        e = new
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
