"""Training packages: real rows with sampled synthetic rows, and their weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import equal_width_bin, quantile_bin
from . import sampling


def quantile_regions(df: DataFrame, by: list[str], bins: int = 3, x: str = "x", y: str = "y") -> DataFrame:
    """df with region r<i>_<j>: bins of the distinct quantiles of x and y over all rows of the group (real and synthetic)."""
    at = F.array(*(F.lit(k / bins) for k in range(bins + 1)))
    edges = df.groupBy(*by).agg(*(F.array_sort(F.array_distinct(F.percentile(c, at))).alias(f"_e{c}") for c in (x, y)))
    joined = df.join(F.broadcast(edges) if not by else edges, by) if by else df.crossJoin(F.broadcast(edges))
    return joined.withColumn("region", F.concat(F.lit("r"), quantile_bin(F.col(x), F.col(f"_e{x}")).cast("string"), F.lit("_"), quantile_bin(F.col(y), F.col(f"_e{y}")).cast("string"))).drop(f"_e{x}", f"_e{y}")


def grid_regions(df: DataFrame, slice_: str, bins: int, extent: Column | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """df with region slice_<s>_grid_<i>_<j>: cells of equal width over the slice's extent (of the rows where `extent` holds)."""
    w = W.partitionBy(slice_)
    inside = extent if extent is not None else F.lit(True)
    cell = lambda c: equal_width_bin(F.col(c), F.min(F.when(inside, F.col(c))).over(w), F.max(F.when(inside, F.col(c))).over(w), bins).cast("string")
    return df.withColumn("region", F.concat(F.lit("slice_"), F.col(slice_), F.lit("_grid_"), cell(x), F.lit("_"), cell(y)))


def region_policy(df: DataFrame, grid: Column, label: Column) -> DataFrame:
    """region_id: the grid cell, else the label, else 'all'."""
    return df.withColumn("region_id", F.coalesce(F.nullif(grid, F.lit("")), F.nullif(label, F.lit("")), F.lit("all")))


def union_tagged(real: DataFrame, synthetic: DataFrame, outer: bool = False) -> DataFrame:
    """All rows with augmentation_source; columns of both sides, or with outer of either (missing ones null)."""
    if not outer:
        common = [c for c in real.columns if c in synthetic.columns]
        real, synthetic = real.select(*common), synthetic.select(*common)
    return real.withColumn("augmentation_source", F.lit("real")).unionByName(synthetic.withColumn("augmentation_source", F.lit("synthetic")), allowMissingColumns=outer)


def weights(package: DataFrame, by: list[str], alpha: Column | float, synthetic_share: bool = True) -> DataFrame:
    """loss_weight: the synthetic rows of a group share alpha (the real ones 1 - alpha), or the other way round."""
    alpha = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    real = F.col("augmentation_source") == "real"
    n = F.count("*").over(W.partitionBy(*by, "augmentation_source"))
    share = F.when(real, 1 - alpha if synthetic_share else alpha).otherwise(alpha if synthetic_share else 1 - alpha)
    return package.withColumn("loss_weight", share / n)


def regional_weights(package: DataFrame, alphas: DataFrame, region: str) -> DataFrame:
    """loss_weight 1 for real rows, the region's alpha for synthetic ones (0 where there is none)."""
    joined = package.join(alphas, region, "left")
    return joined.withColumn("loss_weight", F.when(F.col("augmentation_source") == "real", 1.0).otherwise(F.coalesce("alpha", F.lit(0.0)))).drop("alpha")


Builder = Callable[..., DataFrame]
_BUILDERS: dict[str, Builder] = {}


def register(name: str) -> Callable[[Builder], Builder]:
    """Makes build(real, synthetic, ratio, alpha, seed, label, key) known as a paradigm."""

    def put(f: Builder) -> Builder:
        _BUILDERS[name] = f
        return f

    return put


def builder(name: str) -> Builder:
    if name not in _BUILDERS:
        raise ValueError(f"unknown paradigm {name!r}; known: {sorted(_BUILDERS)}")
    return _BUILDERS[name]


def _uniform(df: DataFrame) -> DataFrame:
    return df.withColumn("loss_weight", F.lit(1.0))


@register("real_baseline")
def real_baseline(real, synthetic=None, ratio=None, alpha=None, seed=0, label="label", key="obs_name"):
    return _uniform(real.withColumn("augmentation_source", F.lit("real")))


@register("real_synthetic")
def real_synthetic(real, synthetic, ratio, alpha=None, seed=0, label="label", key="obs_name"):
    return _uniform(union_tagged(real, sampling.matched(real, synthetic, [label], ratio, seed, key)))


@register("synthetic_only")
def synthetic_only(real, synthetic, ratio, alpha=None, seed=0, label="label", key="obs_name"):
    return _uniform(sampling.matched(real, synthetic, [label], ratio, seed, key).withColumn("augmentation_source", F.lit("synthetic")))


@register("weighted_erm")
def weighted_erm(real, synthetic, ratio, alpha, seed=0, label="label", key="obs_name"):
    """The sample does not depend on alpha; an alpha of 0 is the real rows alone."""
    if alpha == 0:
        return weights(real.withColumn("augmentation_source", F.lit("real")), [], 0.0)
    return weights(union_tagged(real, sampling.matched(real, synthetic, [label], ratio, seed, key)), [], alpha)


@register("local_spatial")
def local_spatial(real, synthetic, ratio, alpha=None, seed=0, label="label", key="obs_name", region="region", levels=3):
    """Sparse regions get up to `ratio` times their real rows, dense ones less: ratio * (level + 1) / levels."""
    ratios = sampling.density_levels(real, region, levels).select(region, ((F.col("level") + 1) * ratio / levels).alias("ratio"))
    return _uniform(union_tagged(real, sampling.by_region_ratio(real, synthetic, ratios, label, region, seed, key)))


@register("regional_weighted_erm")
def regional_weighted_erm(real, synthetic, ratio, alpha, seed=0, label="label", key="obs_name", region="region"):
    package = union_tagged(real, sampling.matched(real, synthetic, [label], ratio, seed, key))
    return regional_weights(package, sampling.density_alphas(real, region, alpha), region)


def slice_pool(drawn: DataFrame, real: DataFrame, model: str, tag: str, seed: int, ratio: float, order: str, slice_: str = "slice_id", label: str = "label") -> DataFrame:
    """The generated rows of all slices and conditions as one pool, with what tells where each comes from.

    drawn: rows of each (slice, label), numbered by `order` within it; real: the training rows, counted by condition (0 where there are none).
    Characters of slices and labels other than letters, digits, `.`, `_` and `-` become `_` in names.
    """
    token = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_")
    n_real = real.groupBy(slice_, label).agg(F.count("*").alias("n_real_train_condition"))
    at = F.row_number().over(W.partitionBy(slice_, label).orderBy(order)) - 1
    named = drawn.withColumn("obs_name", F.concat_ws("_", F.lit("syn"), F.lit(model), token(slice_), token(label), at)).join(n_real, [slice_, label], "left")
    kept = [c for c in drawn.columns if c not in (slice_, label, order)]
    facts = {"split_tag": tag, "random_seed": seed, "pool_ratio": ratio, "generation_scope": "slice_conditional", "condition_key": label}
    return named.select("obs_name", slice_, label, F.col(label).alias("condition_label"), F.lit("synthetic").alias("source"), F.lit(model).alias("generator"), F.coalesce("n_real_train_condition", F.lit(0)).alias("n_real_train_condition"), *(F.lit(v).alias(k) for k, v in facts.items()), *kept)


def variant_grid(spark, families: dict[str, tuple[list[float], list[float]]]) -> DataFrame:
    """(family, ratio, alpha): each family's ratios with its alphas; an empty list gives one null."""
    rows = [(f, r, a) for f, (ratios, alphas) in families.items() for r in (ratios or [None]) for a in (alphas or [None])]
    return spark.createDataFrame(rows, "family string, ratio double, alpha double")
