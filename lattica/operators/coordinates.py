"""Coordinates for synthetic rows: drawn from a fitted mixture, or near reference rows of the same condition. All draws are functions of seed and key."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def uniform(seed: int, number: int, key: Column) -> Column:
    """A draw from (0, 1) for each key: the first 48 bits of md5(seed|number|key)."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(number)), key.cast("string"))), 1, 12), 16, 10)
    return (bits.cast("double") + 0.5) / 2.0**48


def normals(seed: int, number: int, key: Column) -> tuple[Column, Column]:
    """Two independent standard normal draws, from draws number and number + 1."""
    length, angle = F.sqrt(-2 * F.log(uniform(seed, number, key))), 2 * math.pi * uniform(seed, number + 1, key)
    return length * F.cos(angle), length * F.sin(angle)


def sampling_weights(weights: np.ndarray, mode: str = "low_density", threshold: float = 0.3) -> np.ndarray:
    """Shares in which components are drawn: their own ('uniform'), or with those of more than threshold x the mean weight held down to that
    ('low_density'); a threshold of 0 gives the inverse of the weights."""
    if mode == "uniform":
        return weights / weights.sum()
    held = np.minimum(weights, weights.mean() * threshold) if threshold > 0 else 1 / (weights + 1e-8)
    return held / held.sum()


def sampled_from_mixture(rows: DataFrame, parts: list[tuple[float, np.ndarray, np.ndarray]], key: str, seed: int = 42, mode: str = "low_density", threshold: float = 0.3) -> DataFrame:
    """rows with component, x and y drawn from a Gaussian mixture (weight, mean, covariance), in columns alone."""
    ends = np.cumsum(sampling_weights(np.array([w for w, _, _ in parts]), mode, threshold))
    roots = [np.linalg.cholesky(c + 1e-12 * np.eye(2)) for _, _, c in parts]
    numbers = lambda v: F.array(*(F.lit(float(x)) for x in v))
    part = F.least(F.size(F.filter(numbers(ends), lambda e: e <= uniform(seed, 0, F.col(key)))), F.lit(len(parts) - 1))
    one, two = normals(seed, 1, F.col(key))
    drawn = rows.withColumns({"component": part, "_a": one, "_b": two})
    at = lambda v: F.get(numbers(v), F.col("component"))
    x = at([m[0] for _, m, _ in parts]) + at([r[0, 0] for r in roots]) * F.col("_a")
    y = at([m[1] for _, m, _ in parts]) + at([r[1, 0] for r in roots]) * F.col("_a") + at([r[1, 1] for r in roots]) * F.col("_b")
    return drawn.withColumns({"x": x, "y": y}).drop("_a", "_b")


def near_references(rows: DataFrame, reference: DataFrame, key: str, slice_: str = "slice_id", label: str = "label", least: int = 1, sigma: float = 0.08, min_sigma: float = 1e-6, seed: int = 42) -> DataFrame:
    """rows with coord_source, x and y: the place of a reference row of the same condition, moved by a normal draw.

    Each condition takes the references of its slice and label if there are `least` of them, else of its slice, else all; decided from counts in
    one plan. The deviation is sigma times the references' (population), min_sigma at least. Rows keep no x and y without any reference.
    """
    named = lambda level, *cols: F.concat_ws("|", F.lit(level), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols))
    pools = reference.select(F.explode(F.array(named("label", slice_, label), named("slice", slice_), F.lit("all"))).alias("_pool"), F.col(key).alias("_key"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    sizes = pools.groupBy("_pool").agg(F.count("*").alias("_n"), *(F.greatest(F.stddev_pop(f"_{c}") * sigma, F.lit(min_sigma)).alias(f"_s{c}") for c in "xy"))
    conditions = rows.select(slice_, label).distinct().select(F.col(slice_).alias("_slice"), F.col(label).alias("_label"), F.posexplode(F.array(named("label", slice_, label), named("slice", slice_), F.lit("all"))).alias("_level", "_pool"))
    enough = conditions.join(sizes, "_pool").where((F.col("_n") >= least) | (F.col("_level") == 2))
    chosen = enough.groupBy("_slice", "_label").agg(F.min_by(F.struct("_pool", "_level", "_n", "_sx", "_sy"), "_level").alias("_c")).select("_slice", "_label", "_c.*")
    met = rows.drop("x", "y").join(chosen, F.col(slice_).eqNullSafe(F.col("_slice")) & F.col(label).eqNullSafe(F.col("_label")), "left")
    met = met.withColumn("_at", F.floor(uniform(seed, 0, F.col(key)) * F.col("_n")))
    ranked = pools.join(chosen.select("_pool").distinct(), "_pool", "left_semi").withColumn("_at", (F.row_number().over(W.partitionBy("_pool").orderBy("_key")) - 1).cast("long"))
    one, two = normals(seed, 1, F.col(key))
    placed = met.join(ranked.drop("_key"), ["_pool", "_at"], "left")
    source = F.get(F.array(F.lit("label"), F.lit("slice"), F.lit("jitter")), F.col("_level"))
    return placed.select(*(c for c in rows.columns if c not in ("x", "y")), source.alias("coord_source"), (F.col("_x") + F.col("_sx") * one).alias("x"), (F.col("_y") + F.col("_sy") * two).alias("y"))
