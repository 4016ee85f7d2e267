"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours, larger ones (large) or smaller ones, tied to the least of its neighbourhood."""
    a, b = F.col("a"), F.col("b")
    if large:
        both = edges.select("a", "b").unionByName(edges.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # (neighbour, least) for the neighbours above the node; the node itself is tied by its own smaller neighbours.
        return both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
    down = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a")
    return tied.select(b.alias("a"), F.col("m").alias("b")).unionByName(tied.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); a component is named by its least node.

    Nodes are longs. Self-edges and repeated edges change nothing; a node with
    only self-edges isn't listed. No edges give no rows.  The steps go on until one
changes nothing; their number grows with the logarithm of a component's size.
    """
    a, b = F.col("a"), F.col("b")
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = None
    while True:
        now = cut(_star(_star(now, True), False))
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        mark = seen
    stars = now.select(a.alias("node"), b.alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
