"""Sampling and splitting by seeded hash order: without replacement, the same on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_order


def _ranked(df: DataFrame, by: list[str], seed: int, key: str, as_: str = "_rank") -> DataFrame:
    return df.withColumn(as_, F.row_number().over(W.partitionBy(*by).orderBy(hash_order(seed, F.col(key)), key)))


def stratified_split(df: DataFrame, by: list[str], fraction: float, seed: int, key: str) -> DataFrame:
    """split = train for clamp(round(n * fraction), 1, n - 1) rows of each stratum, test for the others; a stratum of one is train."""
    n = F.count("*").over(W.partitionBy(*by))
    take = F.greatest(F.least(F.bround(n * fraction), n - 1), F.lit(1))
    return _ranked(df, by, seed, key).withColumn("split", F.when(F.col("_rank") <= take, "train").otherwise("test")).drop("_rank")


def fraction(df: DataFrame, by: list[str], share: float, seed: int, key: str) -> DataFrame:
    """max(1, round(n * share)) rows of each group."""
    n = F.count("*").over(W.partitionBy(*by))
    return _ranked(df.withColumn("_n", n), by, seed, key).where(F.col("_rank") <= F.greatest(F.bround(F.col("_n") * share), F.lit(1))).drop("_n", "_rank")


def head(df: DataFrame, by: list[str], n: int, seed: int, key: str) -> DataFrame:
    """At most n rows of each group."""
    return _ranked(df, by, seed, key).where(F.col("_rank") <= n).drop("_rank")


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows of all: a distributed top-k, no global sort."""
    return df.orderBy(hash_order(seed, F.col(key)), key).limit(n)


def matched(real: DataFrame, pool: DataFrame, by: list[str], ratio: Column | float, seed: int, key: str) -> DataFrame:
    """Of the pool, max(1, round(n_real * ratio)) rows of each group that the real rows have; all if there are fewer."""
    ratio = F.lit(ratio) if not isinstance(ratio, Column) else ratio
    want = real.groupBy(*by).agg(F.greatest(F.bround(F.count("*") * ratio), F.lit(1)).alias("_want"))
    return _ranked(pool.join(want, by), by, seed, key).where("_rank <= _want").drop("_want", "_rank")


def matched_with_fallback(real: DataFrame, pool: DataFrame, label: str, region: str, ratio: float, seed: int, key: str) -> DataFrame:
    """matched() by label and region; a real group without pool rows takes rows of its label from any region."""
    direct = matched(real, pool, [label, region], ratio, seed, key)
    want = real.groupBy(label, region).agg(F.greatest(F.bround(F.count("*") * ratio), F.lit(1)).alias("_want"))
    lacking = want.join(pool.select(label, region).distinct(), [label, region], "left_anti").groupBy(label).agg(F.sum("_want").alias("_want"))
    spare = _ranked(pool.join(lacking, label), [label], seed, key).where("_rank <= _want").drop("_want", "_rank")
    return direct.unionByName(spare.join(direct.select(key), key, "left_anti"))


def by_region_ratio(real: DataFrame, pool: DataFrame, ratios: DataFrame, label: str, region: str, seed: int, key: str) -> DataFrame:
    """matched() by label and region, each region with a ratio of its own (region, ratio)."""
    want = real.groupBy(label, region).count().join(ratios, region).select(label, region, F.bround(F.col("count") * F.col("ratio")).alias("_want"))
    return _ranked(pool.join(want, [label, region]), [label, region], seed, key).where("_rank <= _want").drop("_want", "_rank")


def density_levels(real: DataFrame, region: str, levels: int) -> DataFrame:
    """(region, n, rank, level): regions from dense to sparse (ties by name), spread over 0 .. levels - 1."""
    counts = real.groupBy(region).agg(F.count("*").alias("n"))
    # a handful of regions: the window over all of them is over their counts
    ranked = counts.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), region)) - 1).withColumn("_r", F.count("*").over(W.partitionBy()))
    return ranked.withColumn("level", F.when(F.col("_r") > 1, F.bround(F.col("rank") * (levels - 1) / (F.col("_r") - 1))).otherwise(0.0).cast("int")).drop("_r")


def density_alphas(real: DataFrame, region: str, most: float) -> DataFrame:
    """(region, alpha): 0 to most in equal steps, dense regions first."""
    counts = real.groupBy(region).agg(F.count("*").alias("n"))
    ranked = counts.withColumn("_k", F.row_number().over(W.orderBy(F.desc("n"), region)) - 1).withColumn("_r", F.count("*").over(W.partitionBy()))
    return ranked.select(region, F.when(F.col("_r") > 1, F.col("_k") * most / (F.col("_r") - 1)).otherwise(0.0).alias("alpha"))


def group_split(df: DataFrame, group: str, stratum: str, shares: tuple[float, float], seed: int) -> DataFrame:
    """Whole groups to train, val, test, by stratum of the group: floor(n * share) of them, train at least one, val only from three on."""
    groups = df.groupBy(group, stratum).count().withColumn("_o", F.row_number().over(W.partitionBy(group).orderBy(F.desc("count"), stratum))).where("_o = 1").drop("_o", "count")
    ranked = _ranked(groups, [stratum], seed, group).withColumn("_n", F.count("*").over(W.partitionBy(stratum)))
    train = F.greatest(F.floor(F.col("_n") * shares[0]), F.lit(1))
    val = F.when(F.col("_n") > 2, F.greatest(F.floor(F.col("_n") * shares[1]), F.lit(1))).otherwise(0)
    named = ranked.select(group, F.when(F.col("_rank") <= train, "train").when(F.col("_rank") <= train + val, "val").otherwise("test").alias("split"))
    return df.join(named, group)


def balanced_head(df: DataFrame, label: str, most: int, seed: int, key: str) -> DataFrame:
    """ceil(most / 2) rows of each of two labels."""
    return head(df, [label], -(-most // 2), seed, key)


def group_folds(df: DataFrame, group: str, stratum: str, folds: int, seed: int) -> DataFrame:
    """fold of each whole group, dealt in hash order in turns within the stratum of the group's most frequent label."""
    groups = df.groupBy(group, stratum).count().withColumn("_o", F.row_number().over(W.partitionBy(group).orderBy(F.desc("count"), stratum))).where("_o = 1").drop("_o", "count")
    return df.join(_ranked(groups, [stratum], seed, group).select(group, ((F.col("_rank") - 1) % folds).cast("int").alias("fold")), group)
