"""Sums over all pairs of a group without a row for any pair: a symmetric join of tiles, each pair of tiles in one task, strip by strip.

A group's rows are dealt by hash over tiles of about TILE rows, and each tile meets itself and the later ones. What is shuffled is rows x tiles, so
large groups have larger tiles, not more of them; a task holds the rows of two tiles and a strip of distances. What leaves it are partial
sums. Rows without a group are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TILE = 2048
#: A group has more tiles than MANY only where its tiles would be of more than LARGE rows; distances of a strip.
MANY = 16
LARGE = 16384
_STRIP = 131_072
#: exp of less than minus this is 0 in double precision.
_UNDERFLOW = 746.0
#: Bins of the distance histogram that brackets a length, and lengths of one exact pass.
_BINS = 4000
_TRIALS = 16


def _tiles(size: int) -> Column:
    n = F.count("*")
    return F.least(F.ceil(n / size), F.greatest(F.lit(MANY), F.ceil(n / LARGE))).cast("int")


def pair_tasks(df: DataFrame, by: str, size: int = TILE) -> int:
    """Tasks for the rows of all pairs: one for each size^2 of them, but no more than four for each pair of tiles, which is not divided."""
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    pairs, keys = df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), _tiles(size).alias("t")).agg(F.sum(n * n), F.sum(t * t)).first()
    return math.ceil(max(1, min(pairs / size**2, 4 * keys))) if pairs else 1


def with_tiles(df: DataFrame, by: str, key: str, size: int = TILE) -> DataFrame:
    """df with _tile and _tiles, the tile of a row and how many its group has."""
    counts = df.groupBy(by).agg(_tiles(size).alias("_tiles"))
    return df.join(F.broadcast(counts), by).withColumn("_tile", F.pmod(F.xxhash64(F.lit(7), key), F.col("_tiles")).cast("int"))


def tile_sums(df: DataFrame, by: str, key: str, columns: list[str], job: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str, size: int = TILE) -> DataFrame:
    """What job(one, two, same) gives for each pair of tiles of a group, each pair once; same: one is two."""
    rows = with_tiles(df, by, key, size).select(by, key, *columns, "_tile", "_tiles")
    one = rows.select(by, key, *columns, F.col("_tile").alias("_a"), F.explode(F.sequence("_tile", F.col("_tiles") - 1)).alias("_b"))
    names = [by, key, *columns]
    two = rows.select(*(F.col(c).alias(f"{c}_2") for c in names), F.explode(F.sequence(F.lit(0), "_tile")).alias("_a2"), F.col("_tile").alias("_b2"))

    def run(keys: tuple, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return job(l[names], r[[f"{c}_2" for c in names]].set_axis(names, axis=1), keys[1] == keys[2])

    return one.groupBy(by, "_a", "_b").cogroup(two.groupBy(f"{by}_2", "_a2", "_b2")).applyInPandas(run, schema)


def _squares(l: pd.DataFrame, r: pd.DataFrame) -> Iterator[tuple[slice, np.ndarray]]:
    """Strips of the matrix of squared distances: which rows of l, and theirs to all of r. A strip is overwritten by the next one."""
    lx, ly, rx, ry = (c.to_numpy(float) for c in (l["x"], l["y"], r["x"], r["y"]))
    step = max(1, _STRIP // max(1, len(r)))
    one, two = np.empty((step, len(r))), np.empty((step, len(r)))
    for at in range(0, len(l), step):
        rows = slice(at, min(at + step, len(l)))
        dx, dy = one[: rows.stop - at], two[: rows.stop - at]
        np.subtract(lx[rows, None], rx[None, :], out=dx)
        np.subtract(ly[rows, None], ry[None, :], out=dy)
        dx *= dx
        dy *= dy
        dx += dy
        yield rows, dx


def adjacency_scales(df: DataFrame, by: str, key: str, lengths: list[float] | dict[str, list[float]], size: int = TILE) -> DataFrame:
    """(by, l, p): p(l), the mean over a group's rows of the sum of exp(-d^2 / 2 l^2) over its rows, less 1. lengths: the same for all groups, or of each."""
    kind = dict(df.dtypes)[by]

    def job(l, r, same):
        if not len(l) or not len(r):
            return pd.DataFrame({by: [], "l": [], "s": []})
        group = l[by].iloc[0]
        trials = lengths[group] if isinstance(lengths, dict) else lengths
        sums, reach = np.zeros(len(trials)), 2 * max(trials) ** 2 * _UNDERFLOW
        for _, d2 in _squares(l, r):
            near = d2[d2 <= reach]
            work = np.empty_like(near)
            for k, t in enumerate(trials):
                np.divide(near, -2 * t * t, out=work)
                sums[k] += np.exp(work, out=work).sum()
        return pd.DataFrame({by: group, "l": trials, "s": sums * (1 if same else 2)})

    sums = tile_sums(df, by, key, ["x", "y"], job, f"`{by}` {kind}, l double, s double", size).groupBy(by, "l").agg(F.sum("s").alias("s"))
    return sums.join(df.groupBy(by).agg(F.count("*").alias("n")), by).select(by, "l", (F.col("s") / F.col("n") - 1).alias("p"))


def distance_sums(df: DataFrame, by: str, key: str, size: int = TILE) -> DataFrame:
    """(by, key, d): of each row the sum of its Euclidean distances to all rows of its group."""
    kinds = dict(df.dtypes)

    def job(l, r, same):
        across, down = np.zeros(len(l)), np.zeros(len(r))
        for rows, d2 in _squares(l, r):
            d = np.sqrt(d2, out=d2)
            across[rows] = d.sum(axis=1)
            if not same:
                down += d.sum(axis=0)
        one = pd.DataFrame({by: l[by], key: l[key], "d": across})
        return one if same else pd.concat([one, pd.DataFrame({by: r[by], key: r[key], "d": down})])

    return tile_sums(df, by, key, ["x", "y"], job, f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, d double", size).groupBy(by, key).agg(F.sum("d").alias("d"))


def distance_histogram(df: DataFrame, by: str, key: str, edges: np.ndarray, size: int = TILE) -> DataFrame:
    """(by, bin, n): ordered pairs, a row with itself too, by the bin of their distance; bin k is up to edges[k], the last one beyond all."""
    kind, squares = dict(df.dtypes)[by], edges * edges

    def job(l, r, same):
        if not len(l) or not len(r):
            return pd.DataFrame({by: [], "bin": [], "n": []})
        n = np.zeros(len(edges) + 1, dtype=np.int64)
        for _, d2 in _squares(l, r):
            # how many are at most each edge: a sorted strip is searched for the edges, not the edges for each distance
            n += np.diff(np.searchsorted(np.sort(d2, axis=None), squares, side="right"), prepend=0, append=d2.size)
        at = np.flatnonzero(n)
        return pd.DataFrame({by: l[by].iloc[0], "bin": at, "n": n[at] * (1 if same else 2)})

    return tile_sums(df, by, key, ["x", "y"], job, f"`{by}` {kind}, bin int, n long", size).groupBy(by, "bin").agg(F.sum("n").alias("n"))


def _crossing(f: Callable[[float], float], target: float, low: float, high: float) -> float:
    """Where the rising f reaches the target, to rounding; an end if it does not."""
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < target else (low, mid)
    return (low + high) / 2


def search_length(df: DataFrame, by: str, key: str, target: float, low: float = 0.001, high: float = 100.0, size: int = TILE) -> DataFrame:
    """(by, l): the length at which p(l) of a group is the target, from low to high; all groups at once.

    One pass makes a histogram of distances, whose bin edges bound p(l) for every l; two passes sum exactly over a few lengths within the bracket
    that is left, a percent wide and then a fifteenth of that. A group without an answer gets the end that is nearest.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[by]
    edges = np.geomspace(low / 100, high * 100, _BINS)
    found = distance_histogram(df, by, key, edges, size).toPandas()  # bins x groups
    bracket = {}
    for group, part in found.groupby(by):
        at, n = part["bin"].to_numpy(), part["n"].to_numpy(float)
        # edges[k - 1] < d <= edges[k]: p is between what the upper and what the lower edges give
        lower, upper = np.where(at > 0, edges[np.maximum(at - 1, 0)], 0.0), np.where(at < _BINS, edges[np.minimum(at, _BINS - 1)], np.inf)
        rows = np.sqrt(n.sum())
        most = lambda l: float((n * np.exp(-lower * lower / (2 * l * l))).sum() / rows - 1)  # noqa: B023, E731
        least = lambda l: float((n * np.where(np.isinf(upper), 0, np.exp(-np.minimum(upper, 1e150) ** 2 / (2 * l * l)))).sum() / rows - 1)  # noqa: B023, E731
        bracket[group] = (_crossing(most, target, low, high), _crossing(least, target, low, high))
    for _ in range(2):
        trials = {g: np.linspace(a, b, _TRIALS).tolist() for g, (a, b) in bracket.items()}
        values = adjacency_scales(df, by, key, trials, size).toPandas()  # trials x groups
        for group, part in values.groupby(by):
            part = part.sort_values("l")
            l, p = part["l"].to_numpy(), part["p"].to_numpy()
            k = int(np.clip(np.searchsorted(p, target), 1, len(l) - 1))
            bracket[group] = (l[k - 1], l[k], p[k - 1], p[k])
        ends = {g: b[2:] for g, b in bracket.items()}
        bracket = {g: b[:2] for g, b in bracket.items()}
    out = []
    for group, (a, b) in bracket.items():
        pa, pb = ends[group]
        share = 0.5 if pb <= pa else min(1.0, max(0.0, (target - pa) / (pb - pa)))
        out.append((group, round(float(a + (b - a) * share), 4)))
    return spark.createDataFrame(out, f"`{by}` {kind}, l double")


def neighbour_counts(df: DataFrame, by: str, key: str, cluster: str, target: str, radii: dict[str, list[float]], size: int = TILE) -> DataFrame:
    """(by, radius, n): mean number of rows, itself included, at most a radius away from the rows of the target cluster; the radii of each group."""
    kind = dict(df.dtypes)[by]

    def job(l, r, same):
        if not len(l) or not len(r):
            return pd.DataFrame({by: [], "radius": [], "n": []})
        group = l[by].iloc[0]
        wanted = np.sort(np.array(radii[group]))
        counts = np.zeros(len(wanted) + 1)
        for one, two in ((l, r),) if same else ((l, r), (r, l)):
            for _, d2 in _squares(one[one[cluster] == target], two):
                counts += np.bincount(np.searchsorted(wanted * wanted, d2.ravel(), side="left"), minlength=len(wanted) + 1)
        return pd.DataFrame({by: group, "radius": wanted, "n": np.cumsum(counts)[:-1]})

    sums = tile_sums(df, by, key, ["x", "y", cluster], job, f"`{by}` {kind}, radius double, n double", size).groupBy(by, "radius").agg(F.sum("n").alias("n"))
    own = df.where(F.col(cluster) == target).groupBy(by).agg(F.count("*").alias("_own"))
    return sums.join(own, by).select(by, "radius", (F.col("n") / F.col("_own")).alias("n"))


def _halves(start: float, end: float, levels: int) -> list[float]:
    mid = (start + end) / 2
    return [mid] if levels == 1 else [*_halves(start, mid, levels - 1), mid, *_halves(mid, end, levels - 1)]


def search_radius(df: DataFrame, by: str, key: str, cluster: str, target: str, start: float, end: float, least: float = 8, most: float = 15, max_run: int = 100, levels: int = 6, size: int = TILE) -> DataFrame:
    """(by, radius): by bisection from start to end the radius within which rows of the target cluster have `least` to `most` rows on average.

    start or end if they do already; null where start has too many, end too few, or no radius was found in max_run halvings. All radii of `levels`
    halvings are counted in one pass, so the steps of a bisection cost a pass for each six of them.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[by]
    groups = [r[0] for r in df.where((F.col(cluster) == target) & F.col(by).isNotNull()).select(by).distinct().collect()]  # a bracket each
    df = df.where(F.col(by).isin(groups)) if groups else df.limit(0)
    state, answer, runs = {g: (start, end) for g in groups}, {}, dict.fromkeys(groups, 0)
    while state:
        radii = {g: sorted({a, b, *_halves(a, b, levels)}) for g, (a, b) in state.items()}
        counts = {(r[by], r["radius"]): r["n"] for r in neighbour_counts(df.where(F.col(by).isin(list(state))), by, key, cluster, target, radii, size).collect()}
        for g, (a, b) in list(state.items()):
            fits = lambda x: least <= counts[g, x] <= most  # noqa: B023, E731
            if runs[g] == 0 and (fits(a) or fits(b) or counts[g, a] > most or counts[g, b] < least):
                answer[g] = a if fits(a) else b if fits(b) else None
            for _ in range(levels):
                if g in answer:
                    break
                runs[g] += 1
                mid = (a + b) / 2
                if runs[g] > max_run or not a < mid < b:
                    answer[g] = None
                elif fits(mid):
                    answer[g] = mid
                else:
                    a, b = (mid, b) if counts[g, mid] < least else (a, mid)
            if g in answer:
                del state[g]
            else:
                state[g] = (a, b)
    return spark.createDataFrame([(g, r) for g, r in answer.items()], f"`{by}` {kind}, radius double")


def search_resolution(clusters_at: Callable[[float], int], wanted: int, start: float = 0.4, step: float = 0.1, max_run: int = 10) -> float:
    """The resolution that gives so many clusters, by steps towards it that are halved when they overshoot; the last one reached if none does.

    clusters_at: number of clusters that a (distributed) clustering finds at a resolution.
    """
    resolution, found = start, clusters_at(start)
    for _ in range(max_run + 1):
        if found == wanted:
            break
        sign = 1 if found < wanted else -1
        n = clusters_at(resolution + step * sign)
        if n == wanted:
            return resolution + step * sign
        if (1 if n < wanted else -1) == sign:
            resolution, found = resolution + step * sign, n
        else:
            step /= 2
    return resolution


def cluster_distances(df: DataFrame, by: str, key: str, cluster: str, size: int = TILE) -> DataFrame:
    """(by, key, own, other, d): of each row the sum of its distances to the rows of each cluster of its group."""
    kinds = dict(df.dtypes)

    def side(one, names, sums):
        n = len(names)
        return pd.DataFrame({by: np.repeat(one[by].to_numpy(), n), key: np.repeat(one[key].to_numpy(), n), "own": np.repeat(one[cluster].to_numpy(), n), "other": np.tile(names, len(one)), "d": sums.ravel()})

    def job(l, r, same):
        (names_l, l_codes), (names_r, r_codes) = (np.unique(s[cluster].to_numpy(), return_inverse=True) for s in (l, r))
        of_l, of_r = np.eye(len(names_l))[l_codes], np.eye(len(names_r))[r_codes]
        across, down = np.zeros((len(l), len(names_r))), np.zeros((len(r), len(names_l)))
        for rows, d2 in _squares(l, r):
            d = np.sqrt(d2, out=d2)
            across[rows] = d @ of_r
            if not same:
                down += d.T @ of_l[rows]
        return side(l, names_r, across) if same else pd.concat([side(l, names_r, across), side(r, names_l, down)])

    fields = f"`{by}` {kinds[by]}, `{key}` {kinds[key]}, own {kinds[cluster]}, other {kinds[cluster]}, d double"
    return tile_sums(df, by, key, ["x", "y", cluster], job, fields, size).groupBy(by, key, "own", "other").agg(F.sum("d").alias("d"))
