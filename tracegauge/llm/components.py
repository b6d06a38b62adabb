"""Connected components by alternating large-star and small-star steps; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegauge.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours to the smallest node around it: the larger ones (large), or the smaller ones and itself."""
    if large:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    linked = both.join(least, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; ``root`` is the smallest node of its component.

    ``edges`` has columns a, b of one ordered type, without nulls; self-links and repeats are harmless.
    A hot node is only ever the centre of a star: its edges are joined with one row, which Spark may split.
    The rounds end when both steps change nothing (about the logarithm of the longest chain).
    """
    edges = materialize(edges.where("a != b").distinct(), "links")
    before = None
    while True:
        after = materialize(_star(_star(edges, True), False), "stars")
        discard(edges)
        edges = after
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
