"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemiciclo.llm.common import stash


def _directed(edges: DataFrame) -> DataFrame:
    """node, other: each edge from both ends."""
    return edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")


def _star(pairs: DataFrame, keep) -> DataFrame:
    """Each node of `pairs` (node, other) hangs its others, those that `keep` names, on the least of them and itself.

    The least comes from an aggregate that combines before the shuffle and is joined back, so that a node with very
    many others is spread over tasks by the join's skew handling.
    """
    least = pairs.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
    hung = pairs.join(least, "node").where(keep & (F.col("other") != F.col("least"))).select(F.col("least").alias("a"), F.col("other").alias("b"))
    return hung, least


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (longs). Returns node, component (its least node) for every node that has a link to another.

    Each round writes the edges to the shared folder; the number of rounds grows with the logarithm of the number of
    nodes. At the end each node has one edge, to its component's least node. NULL ends, loops and repeated links
    are ignored.
    """
    edges = stash(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    was = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())) != was:
        was = now
        if not now[0]:
            break
        large, _ = _star(_directed(edges), F.col("other") > F.col("node"))
        large = large.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        down = large.select(F.col("b").alias("node"), F.col("a").alias("other"))
        small, least = _star(down, F.lit(True))
        small = small.union(least.select(F.col("least").alias("a"), F.col("node").alias("b")))
        edges = stash(small.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "stars")
    return edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
