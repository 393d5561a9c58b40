"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from splitlane.session import settle


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Tie each node's neighbours (the larger ones, or the node and its smaller ones) to its smallest."""
    if large:
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        around = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    lowest = settle(around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")), "lowest")
    joined = around.join(lowest, "a")
    moved = joined.filter(F.col("b") > F.col("a")) if large else joined
    out = moved.select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        out = out.unionByName(lowest.select("a", F.col("low").alias("b")))
    return settle(out.filter("a != b").distinct(), "edges")


def connected_components(edges: DataFrame) -> DataFrame:
    """a, b of ``edges``: a row (node, root) for every node of an edge; the root is the smallest node.

    Any number of edges per node; the number of steps grows with the logarithm of the
    longest path. Each step is written, so that lost executors cost one step at most.
    """
    edges = settle(edges.select("a", "b").filter("a != b").distinct(), "edges")
    before = None
    while True:
        edges = _star(_star(edges, True), False)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")))
        .distinct()
    )
