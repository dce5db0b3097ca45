"""Count simulators per condition, coordinates for synthetic rows, and diffusion schedules.

Every condition (slice and label) is fitted and drawn on its own, seeded by its key, so a retry gives the same rows.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import hash_order
from .fits import choose_law, fit_counts


def condition_seed(base: int, *parts) -> int:
    return base + int(hashlib.sha256("||".join(map(str, parts)).encode()).hexdigest()[:8], 16) % 100_000


def rows_wanted(n_real: int, ratio: float) -> int:
    return max(1, round(n_real * ratio))


@dataclass
class Libraries:
    """Library sizes: one of those seen, times a lognormal factor, at most 2.5 times the largest."""

    seen: np.ndarray
    jitter: float = 0.1

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        drawn = rng.choice(self.seen, n) * np.exp(rng.normal(0, self.jitter, n))
        return np.minimum(np.maximum(np.rint(drawn), 1), 2.5 * max(self.seen.max(), 1)).astype(np.int64)


def rank_placed(values: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Sorted values at the places that reference has in order (ties by place)."""
    out = np.empty_like(values)
    out[np.argsort(reference, kind="stable")] = np.sort(values)
    return out


def rescue_zeros(counts: np.ndarray, wanted: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One count in a random row for each gene that should be seen and is not."""
    for g in np.nonzero((counts.sum(axis=0) == 0) & wanted)[0]:
        counts[rng.integers(len(counts)), g] = 1
    return counts


def gamma_hypergeometric(x: np.ndarray, n: int, rng: np.random.Generator, depth: int = 10) -> np.ndarray:
    """Gamma composition per gene, counts drawn without replacement from a pool `depth` times the library, then dropout beyond what the law explains.

    Where the composition drawn is all zero, the mean one is used."""
    lib = Libraries(x.sum(axis=1))
    scaled = x / np.maximum(x.sum(axis=1, keepdims=True), 1) * max(np.median(x.sum(axis=1)), 1)
    mean, var = scaled.mean(axis=0), np.maximum(scaled.var(axis=0, ddof=1) if len(x) > 1 else 0 * scaled[0], 1e-8)
    shape, scale = np.maximum(mean, 1e-8) ** 2 / var, var / np.maximum(mean, 1e-8)
    drop = np.clip((x == 0).mean(axis=0) - np.exp(-mean), 0, 0.95)
    out = np.zeros((n, x.shape[1]), dtype=np.int64)
    for i, size in enumerate(lib.draw(n, rng)):
        profile = np.where(mean > 0, rng.gamma(shape, scale), 0)
        if profile.sum() <= 0:
            profile = mean
        if profile.sum() <= 0:
            continue
        pool = rng.multinomial(int(size) * depth, profile / profile.sum())
        out[i] = rng.multivariate_hypergeometric(pool, min(int(size), int(pool.sum())), method="marginals")
        out[i][rng.random(x.shape[1]) < drop] = 0
    return out


def gamma_poisson(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Gene means with outliers, biological variation that falls with the mean, Poisson counts, logistic dropout."""
    lib = Libraries(x.sum(axis=1))
    mean = x.mean(axis=0)
    share = mean / max(mean.sum(), 1e-9)
    base = share[None, :] * lib.draw(n, rng)[:, None]
    bcv = 0.1 + 1 / np.sqrt(np.maximum(base, 1e-6) + 1)
    lam = np.where(base > 0, rng.gamma(1 / bcv**2, np.maximum(base, 1e-12) * bcv**2), 0)
    counts = rng.poisson(np.minimum(lam, 1e8))
    excess = np.clip((x == 0).mean(axis=0) - np.exp(-mean), 0, 0.95)
    counts[rng.random(counts.shape) < excess[None, :]] = 0
    return rescue_zeros(counts, mean > 0, rng)


def marginal_ranks(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Each gene from its own chosen law, placed by the ranks of the real rows (taken in turns beyond their number)."""
    out = np.zeros((n, x.shape[1]), dtype=np.int64)
    for g in range(x.shape[1]):
        y = x[:, g]
        if not y.any():
            continue
        fits = fit_counts(y)
        f = fits[choose_law(fits)]
        mean = np.full(n, f["mean"])
        drawn = rng.poisson(mean) if not math.isfinite(f["theta"]) else rng.poisson(rng.gamma(f["theta"], mean / f["theta"]))
        drawn[rng.random(n) < f["p0"]] = 0
        for k in range(0, n, len(y)):
            part = drawn[k : k + len(y)]
            out[k : k + len(y), g] = rank_placed(part, y[: len(part)])
    return rescue_zeros(out, x.sum(axis=0) > 0, rng)


def negative_binomial(x: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Each gene NB by moments, rows rescaled to a drawn library, extra zeros by chance."""
    mean, var = x.mean(axis=0), (x.var(axis=0, ddof=1) if len(x) > 1 else x.mean(axis=0))
    theta = np.where(var > mean, np.clip(mean**2 / np.maximum(var - mean, 1e-9), 1e-3, 1e6), 1e6)
    lam = np.where(mean > 0, rng.gamma(theta, np.maximum(mean, 1e-12) / theta, (n, len(mean))), 0)
    size = Libraries(x.sum(axis=1)).draw(n, rng)
    counts = rng.poisson(lam * (size / np.maximum(lam.sum(axis=1), 1e-9))[:, None])
    return rescue_zeros(counts, mean > 0, rng)


SIMULATORS = {"gamma_hypergeometric": gamma_hypergeometric, "gamma_poisson": gamma_poisson, "marginal_ranks": marginal_ranks, "negative_binomial": negative_binomial}


def simulated(expr: DataFrame, by: list[str], spot: str, gene: str, value: str, simulator: str, ratio: float = 1.0, seed: int = 42) -> DataFrame:
    """(by, synthetic_id, gene, value): max(1, round(n_real * ratio)) synthetic rows of each condition, zeros left out.

    A condition's long expression (one label of one slice, a bounded block) is one Arrow group; conditions run side by side.
    """
    kinds = dict(expr.dtypes)
    make = SIMULATORS[simulator]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[c].iloc[0] for c in by]
        spots, rows = np.unique(pdf[spot], return_inverse=True)
        genes, cols = np.unique(pdf[gene], return_inverse=True)
        x = np.zeros((len(spots), len(genes)))
        np.add.at(x, (rows, cols), pdf[value].to_numpy(dtype=float))
        out = make(np.rint(np.maximum(x, 0)), rows_wanted(len(spots), ratio), np.random.default_rng(condition_seed(seed, simulator, *key)))
        i, g = np.nonzero(out)
        name = "_".join([simulator, *(str(k).replace("/", "-").replace(" ", "-") for k in key)])
        return pd.DataFrame({**dict(zip(by, key)), "synthetic_id": [f"{name}_{k}" for k in i], gene: genes[g], value: out[i, g].astype(float)})

    fields = ", ".join(f"{c} {kinds[c]}" for c in by) + f", synthetic_id string, {gene} {kinds[gene]}, {value} double"
    return expr.select(*by, spot, gene, F.col(value).cast("double").alias(value)).groupBy(*by).applyInPandas(run, fields)


def jittered(rows: DataFrame, reference: DataFrame, by: list[str], key: str, sigma: float, seed: int, least: float = 1e-6) -> DataFrame:
    """Coordinates of a reference row picked by hash, plus normal noise of sigma times the group's population deviation.

    The noise is made from the hash (Box-Muller), so it depends on seed and key alone.
    """
    w = W.partitionBy(*by)
    ref = reference.select(*by, F.col("x").alias("_x"), F.col("y").alias("_y"), (F.row_number().over(w.orderBy(key)) - 1).alias("_at"), F.count("*").over(w).alias("_n"), F.stddev_pop("x").over(w).alias("_sx"), F.stddev_pop("y").over(w).alias("_sy"))
    sizes = ref.groupBy(*by).agg(F.max("_n").alias("_m"))
    digest = hash_order(seed, F.col(key))
    part = lambda k: F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("double")
    u, v = (part(1) + 1) / 4294967297.0, part(2) / 4294967296.0
    r = F.sqrt(-2 * F.log(u))
    picked = rows.drop("x", "y").join(sizes, by).withColumn("_at", (part(0).cast("long") % F.col("_m")).cast("int")).join(ref, [*by, "_at"])
    noise = lambda s, f: F.greatest(F.col(s) * sigma, F.lit(least)) * r * f(2 * math.pi * v)
    return picked.withColumn("x", F.col("_x") + noise("_sx", F.cos)).withColumn("y", F.col("_y") + noise("_sy", F.sin)).drop("_x", "_y", "_at", "_n", "_m", "_sx", "_sy")


def noised(df: DataFrame, vector: str, noise: str, alpha_bar: float) -> DataFrame:
    """Forward diffusion: sqrt(a) x + sqrt(1 - a) e, element by element."""
    return df.withColumn(vector, F.zip_with(vector, noise, lambda x, e: math.sqrt(alpha_bar) * x + math.sqrt(1 - alpha_bar) * e))


def alpha_bars(betas: list[float]) -> list[float]:
    return np.cumprod(1 - np.array(betas)).tolist()


def posterior(betas: list[float]) -> list[tuple[float, float, float]]:
    """(variance, coefficient of x0, coefficient of x_t) of each step's posterior."""
    out, before = [], 1.0
    for b, a in zip(betas, alpha_bars(betas)):
        out.append((b * (1 - before) / (1 - a), b * math.sqrt(before) / (1 - a), (1 - before) * math.sqrt(1 - b) / (1 - a)))
        before = a
    return out


def timestep_embedding(t: int, dim: int, longest: float = 10_000.0) -> list[float]:
    half = dim // 2
    angles = [t * math.exp(-math.log(longest) * k / half) for k in range(half)]
    return [math.cos(a) for a in angles] + [math.sin(a) for a in angles] + [0.0] * (dim % 2)
