"""Distributed union-find: alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """Components of an undirected graph.

    edges: columns a, b of one ordered type; self-loops, nulls and repeated edges are ignored.
    Returns (node, root), root being the least node of the component, for every node with an edge.
    A step touches only the edges, never a whole neighbourhood in one row, so a hub is summed by
    partial aggregation and its join is split by adaptive execution. Each round is cut to the
    shared folder. The table of an empty graph is empty.
    """
    now = cut(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        roles = now.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        # done when all are stars: no node has two edges up, or one up and one down
        roles = roles.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if not roles.where("below > 1 or (below = 1 and above = 1)").limit(1).count():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = cut(_small_star(_large_star(now)))
