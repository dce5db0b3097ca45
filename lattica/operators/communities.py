"""Communities of neighbour graphs by local moving, refinement into connected parts and contraction; all steps are joins and grouped sums.

Graphs are edge tables (by, src, dst, w) with both directions of each edge; many graphs (slices) are clustered at once. The driver holds one modularity
for each graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.bundle import stored

#: Rounds of moves of a level (each of two halves), levels, and passes over all levels from the communities found so far.
ROUNDS = 8
LEVELS = 10
PASSES = 2
#: A pass over one half of the nodes that adds less to the modularity than this ends the moving of a graph.
LEAST_GAIN = 1e-4


def modularity(edges: DataFrame, labels: DataFrame, by: str, resolution: float = 1.0) -> DataFrame:
    """(by, q) of communities (by, node, comm)."""
    one = labels.select(by, F.col("node").alias("src"), F.col("comm").alias("_one"))
    two = labels.select(by, F.col("node").alias("dst"), F.col("comm").alias("_two"))
    both = edges.join(one, [by, "src"]).join(two, [by, "dst"])
    sums = both.groupBy(by, "_one").agg(F.sum("w").alias("k"), F.sum(F.when(F.col("_one") == F.col("_two"), F.col("w")).otherwise(0.0)).alias("inside"))
    whole = sums.withColumn("m", F.sum("k").over(W.partitionBy(by)))
    return whole.groupBy(by).agg(F.sum(F.col("inside") / F.col("m") - resolution * F.pow(F.col("k") / F.col("m"), 2)).alias("q"))


def _moved(edges: DataFrame, labels: DataFrame, by: str, resolution: float, half: int, turn: int) -> DataFrame:
    """labels (by, node, comm, k, m) after the nodes of one half went to the neighbouring community of the largest gain."""
    sums = labels.groupBy(by, "comm").agg(F.sum("k").alias("_total"))
    near = labels.select(by, F.col("node").alias("dst"), "comm")
    links = edges.where("src != dst").join(near, [by, "dst"]).groupBy(by, F.col("src").alias("node"), "comm").agg(F.sum("w").alias("_link"))
    # its own community is a choice too, with or without a link to it
    choices = links.unionByName(labels.select(by, "node", "comm", F.lit(0.0).alias("_link"))).groupBy(by, "node", "comm").agg(F.sum("_link").alias("_link"))
    own = labels.select(by, "node", F.col("comm").alias("_own"), "k", "m")
    rated = choices.join(own, [by, "node"]).join(sums, [by, "comm"])
    stays = F.col("comm") == F.col("_own")
    gain = F.col("_link") - resolution * F.col("k") * (F.col("_total") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m")
    # a tie of rounding size is no reason to leave
    gain = gain + F.when(stays, 1e-9 * F.col("k")).otherwise(0.0)
    # of equal gains the community of the least name
    best = rated.groupBy(by, "node").agg(F.first("k").alias("k"), F.first("m").alias("m"), F.first("_own").alias("_own"), F.max(gain).alias("_top"), F.collect_list(F.struct(gain.alias("g"), "comm")).alias("_all"))
    to = F.array_min(F.transform(F.filter("_all", lambda c: c["g"] == F.col("_top")), lambda c: c["comm"]))
    mine = F.pmod(F.xxhash64(F.lit(turn), "node"), F.lit(2)) == half
    return best.select(by, "node", F.when(mine, to).otherwise(F.col("_own")).alias("comm"), "k", "m")


def _local_moves(edges: DataFrame, labels: DataFrame, by: str, resolution: float, rounds: int, turn: int) -> DataFrame:
    """labels after rounds of moves; a graph whose modularity a half does not raise keeps what it had."""
    now = {r[by]: r["q"] for r in modularity(edges, labels, by, resolution).collect()}  # one number a graph
    active = set(now)
    for k in range(rounds):
        gained = set()
        for half in (0, 1):
            tried = stored(_moved(edges, labels, by, resolution, half, turn + k), "moves")
            after = {r[by]: r["q"] for r in modularity(edges, tried, by, resolution).collect()}
            better = [g for g in active if after[g] > now[g]]
            gained |= {g for g in better if after[g] > now[g] + LEAST_GAIN}
            if better:
                chosen = F.col(by).isin(better)
                labels = tried if len(better) == len(now) else stored(tried.where(chosen).unionByName(labels.where(~chosen)), "labels")
                now |= {g: after[g] for g in better}
        active &= gained
        if not active:
            break
    return labels


def connected_parts(edges: DataFrame, labels: DataFrame, by: str) -> DataFrame:
    """labels with each community split into its connected parts, named by their least node: neighbours hand on the least name, and names
    are followed to their own names, so long paths shorten by halves."""
    one = labels.select(by, F.col("node").alias("src"), F.col("comm").alias("_one"))
    two = labels.select(by, F.col("node").alias("dst"), F.col("comm").alias("_two"))
    inside = stored(edges.where("src != dst").join(one, [by, "src"]).join(two, [by, "dst"]).where("_one = _two").select(by, "src", "dst"), "inside")
    parts = labels.select(by, "node", F.col("node").alias("part"))
    while True:
        near = inside.join(parts.select(by, F.col("node").alias("dst"), "part"), [by, "dst"]).groupBy(by, F.col("src").alias("node")).agg(F.min("part").alias("_near"))
        lower = parts.join(near, [by, "node"], "left").select(by, "node", "part", F.least("part", F.coalesce("_near", "part")).alias("_low"))
        jump = lower.select(by, F.col("node").alias("_low"), F.col("_low").alias("_jump"))
        new = stored(lower.join(jump, [by, "_low"]).select(by, "node", F.col("_jump").alias("part"), (F.col("_jump") != F.col("part")).alias("changed")), "parts")
        parts = new.select(by, "node", "part")
        if not new.where("changed").limit(1).count():
            break
    return labels.drop("comm").join(parts.withColumnRenamed("part", "comm"), [by, "node"])


def _named(labels: DataFrame, by: str) -> DataFrame:
    """labels with communities named by their least node."""
    least = labels.groupBy(by, "comm").agg(F.min("node").alias("_name"))
    return labels.join(least, [by, "comm"]).drop("comm").withColumnRenamed("_name", "comm")


def find_communities(edges: DataFrame, by: str, resolution: float = 1.0, rounds: int = ROUNDS, levels: int = LEVELS, passes: int = PASSES) -> DataFrame:
    """(by, key, cluster): a connected community of each node that has an edge, numbered in each graph from 0 by their least nodes.

    A level moves nodes to the neighbouring community of the largest gain in modularity, one half of them at a time (which half is a hash that
    changes with the round, so that neighbours do not swap for ever), splits communities that fell apart, and makes each of them a node of
    the next level. A second pass starts from the communities found. No step holds a graph, a community or a neighbourhood in one task beyond
    the number of communities next to a node. Edges of weight 0 or null are left out; an empty table gives none.
    """
    kind = dict(edges.dtypes)["src"]
    base = stored(edges.where("w > 0").select(by, "src", "dst", F.col("w").cast("double").alias("w")), "graph")
    owner = None
    for turn in range(passes):
        graph, own = base, base.select(by, F.col("src").alias("key")).distinct().withColumn("node", F.col("key"))
        own = stored(own, "owners")
        for level in range(levels):
            degree = graph.groupBy(by, F.col("src").alias("node")).agg(F.sum("w").alias("k"))
            start = degree.withColumn("m", F.sum("k").over(W.partitionBy(by)))
            if level or owner is None:
                start = start.withColumn("comm", F.col("node"))
            else:
                start = start.join(owner.select(by, F.col("key").alias("node"), F.col("node").alias("comm")), [by, "node"])
            start = stored(start.select(by, "node", "comm", "k", "m"), "labels")
            found = _local_moves(graph, start, by, resolution, rounds, 100 * turn + 10 * level)
            found = stored(_named(connected_parts(graph, found, by), by), "communities")
            n_before, n_after = start.count(), found.select(by, "comm").distinct().count()
            own = stored(own.join(found.select(by, "node", "comm"), [by, "node"]).select(by, "key", F.col("comm").alias("node")), "owners")
            if n_after == n_before:
                break
            a, b = found.select(by, F.col("node").alias("src"), F.col("comm").alias("_a")), found.select(by, F.col("node").alias("dst"), F.col("comm").alias("_b"))
            graph = stored(graph.join(a, [by, "src"]).join(b, [by, "dst"]).groupBy(by, F.col("_a").alias("src"), F.col("_b").alias("dst")).agg(F.sum("w").alias("w")), "graph")
        owner = own
    if owner is None:
        return base.select(by, F.col("src").cast(kind).alias("key"), F.lit("0").alias("cluster")).limit(0)
    first = owner.groupBy(by, "node").agg(F.min("key").alias("_first"))
    # one row a community
    numbers = first.withColumn("cluster", (F.row_number().over(W.partitionBy(by).orderBy("_first")) - 1).cast("string"))
    return owner.join(numbers.select(by, "node", "cluster"), [by, "node"]).select(by, "key", "cluster")


def fallback_k(n: int) -> int:
    """Clusters of the k-means fallback for n rows: the root of half of them, 2 to 10."""
    return int(np.clip(int(np.sqrt(n / 2)), 2, 10))


def kmeans_clusters(df: DataFrame, key: str, vector: str, seed: int = 42) -> DataFrame:
    """(key, cluster) by k-means where there is no graph to go by; fewer than two rows are one cluster."""
    n = df.count()
    if n < 2:
        return df.select(key, F.lit("0").alias("cluster"))
    model = KMeans(k=min(n, fallback_k(n)), seed=seed, featuresCol="_v", predictionCol="_c").fit(df.select(array_to_vector(vector).alias("_v")))
    return model.transform(df.withColumn("_v", array_to_vector(vector))).select(key, F.col("_c").cast("string").alias("cluster"))
