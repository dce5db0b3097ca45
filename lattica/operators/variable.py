"""Highly variable genes: a ranking by variance after stabilisation along the mean, and one by dispersion within bins of the mean.

Expression is long (spot, gene, value); spots without a row for a gene count as 0. Only a row for each distinct mean reaches the driver
(of whole counts, there are as many as distinct totals at most).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.bundle import stored

#: Share of the genes in the window of a local fit, and distinct means that a fit needs.
SPAN = 0.3
LEAST_MEANS = 6
BINS = 20


def gene_moments(expr: DataFrame, gene: str = "gene_idx", spot: str = "spot", value: str = "value") -> tuple[DataFrame, int]:
    """(gene, mean, variance) over all n spots, and n. Zeros that have no row are counted in; the variance has divisor n - 1."""
    n = expr.agg(F.count_distinct(spot)).first()[0]
    k, own = F.count(value), F.avg(value)
    whole = F.var_pop(value) * k + own * own * k * (F.lit(n) - k) / F.lit(float(max(n, 1)))
    return expr.groupBy(gene).agg((F.sum(value) / F.lit(float(max(n, 1)))).alias("mean"), (whole / F.lit(float(max(n - 1, 1)))).alias("variance")), n


#: Points of a block whose moments stand for it, and rows of one step of a fit.
_BLOCK = 64
_ROWS = 2048
_POWERS = 14


def _moments(x: np.ndarray, often: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centre and half width of each row of x, and the sums of often v^e and total v^e, v the place within the row from -1 to 1."""
    low, high = x[:, 0], x[:, -1]
    centre, half = (low + high) / 2, np.where(high > low, (high - low) / 2, 1.0)
    v, power = (x - centre[:, None]) / half[:, None], np.ones_like(x)
    out = np.empty((len(x), 2, _POWERS))
    for e in range(_POWERS):
        out[:, 0, e], out[:, 1, e] = (often * power).sum(axis=1), (total * power).sum(axis=1)
        power = power * v
    return centre, half, out


class LocalQuadratic:
    """Tricube-weighted quadratic fits over the floor(span n) nearest points, for any number of them.

    The points are (x, y), x in order; of a point that stands for several, often is their number and y their mean. A window is a run of the
    points, found by bisection. The tricube weight is a polynomial on either side of the window's centre, so whole blocks of points enter
    by their moments, joined in pairs level by level, and only the blocks at the ends and at the centre point by point: the work of
    a fit grows with the logarithm of the number of points.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, span: float, often: np.ndarray | None = None):
        often = np.ones(len(x)) if often is None else np.asarray(often, dtype=float)
        self.ends = np.cumsum(often).astype(np.int64)
        self.q = max(1, int(span * self.ends[-1]))
        # blocks are filled with points that occur 0 times
        fill = -len(x) % _BLOCK
        self.n, self.x = len(x), np.concatenate([x, np.full(fill, x[-1])])
        self.often, self.total = np.concatenate([often, np.zeros(fill)]), np.concatenate([often * y, np.zeros(fill)])
        self.levels, size = [], _BLOCK
        while size <= len(self.x):
            whole = len(self.x) // size * size
            self.levels.append(_moments(*(c[:whole].reshape(-1, size) for c in (self.x, self.often, self.total))))
            size *= 2

    def _at(self, place: np.ndarray) -> np.ndarray:
        """The x of a place among all points, each as often as it occurs."""
        return self.x[np.searchsorted(self.ends, place, side="right")]

    def _added(self, sums: np.ndarray, p: np.ndarray, h: np.ndarray, rows: np.ndarray, level: int, nodes: np.ndarray, sign: float) -> None:
        """Adds what nodes of a level give to the sums of the rows; sign: -1 where they lie above the row's p, 1 below."""
        centre, half, moments = (c[nodes] for c in self.levels[level])
        a, b = (half / h[rows])[:, None], ((centre - p[rows]) / h[rows])[:, None]
        # moments about p in units of h, one power after the other: u^e = u^(e-1) (a v + b)
        now, about = moments, np.empty_like(moments)
        for e in range(_POWERS):
            about[:, :, e] = now[:, :, 0]
            now = a[:, :, None] * now[:, :, 1:] + b[:, :, None] * now[:, :, :-1]
        for e in range(5):
            sums[rows, :, e] += about[:, :, e] + sign * 3 * about[:, :, e + 3] + 3 * about[:, :, e + 6] + sign * about[:, :, e + 9]

    def _blocks(self, sums, p, h, first: np.ndarray, last: np.ndarray, sign: float) -> None:
        """Adds the blocks from first to before last."""
        first, last, level = first.copy(), np.maximum(first, last), 0
        while level < len(self.levels) and (first < last).any():
            rows = np.flatnonzero((first < last) & (first % 2 == 1))
            if len(rows):
                self._added(sums, p, h, rows, level, first[rows], sign)
                first[rows] += 1
            rows = np.flatnonzero((first < last) & (last % 2 == 1))
            if len(rows):
                last[rows] -= 1
                self._added(sums, p, h, rows, level, last[rows], sign)
            first, last, level = first // 2, last // 2, level + 1

    def _points(self, sums, p, h, rows: np.ndarray, block: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        """Adds the points of a block for each row, as far as they are from place low to before high."""
        at = block[:, None] * _BLOCK + np.arange(_BLOCK)
        u = (self.x[at] - p[rows, None]) / h[rows, None]
        w = np.where((at >= low[rows, None]) & (at < high[rows, None]), (1 - np.minimum(np.abs(u), 1) ** 3) ** 3, 0.0)
        one, two = w * self.often[at], w * self.total[at]
        for e in range(5):
            sums[rows, 0, e] += one.sum(axis=1)
            sums[rows, 1, e] += two.sum(axis=1)
            one, two = one * u, two * u

    def __call__(self, at: np.ndarray) -> np.ndarray:
        """The fit's value at each x."""
        return np.concatenate([self._some(at[k : k + _ROWS]) for k in range(0, len(at), _ROWS)]) if len(at) else np.empty(0)

    def _some(self, p: np.ndarray) -> np.ndarray:
        # the window of q places of least reach
        low, high = np.zeros(len(p), dtype=np.int64), np.full(len(p), self.ends[-1] - self.q)
        while (low < high).any():
            mid = (low + high) // 2
            right = (p - self._at(mid) > self._at(np.minimum(mid + self.q, self.ends[-1] - 1)) - p) & (low < high)
            low, high = np.where(right, mid + 1, low), np.where(right, high, mid)
        h = np.maximum(np.abs(p - self._at(low)), np.abs(self._at(low + self.q - 1) - p))
        first = np.searchsorted(self.ends, low, side="right")
        last = np.searchsorted(self.ends, low + self.q - 1, side="right") + 1
        # where all q are at p, all points at p count
        narrow = h <= 0
        x = self.x[: self.n]
        first, last = np.where(narrow, np.searchsorted(x, p, side="left"), first), np.where(narrow, np.searchsorted(x, p, side="right"), last)
        h = np.where(narrow, 1.0, h)
        sums = np.zeros((len(p), 2, 5))
        a, b = first // _BLOCK, (last - 1) // _BLOCK
        middle = np.clip(np.searchsorted(x, p), first, last - 1) // _BLOCK
        rows = np.arange(len(p))
        self._points(sums, p, h, rows, a, first, last)
        for block, other in ((middle, middle != a), (b, (b != a) & (b != middle))):
            self._points(sums, p, h, rows[other], block[other], first, last)
        self._blocks(sums, p, h, a + 1, middle, 1.0)
        self._blocks(sums, p, h, middle + 1, b, -1.0)
        s, t = sums[:, 0].T, sums[:, 1].T
        minor = s[2] * s[4] - s[3] * s[3]
        det = s[0] * minor - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
        top = t[0] * minor - s[1] * (t[1] * s[4] - t[2] * s[3]) + s[2] * (t[1] * s[3] - t[2] * s[2])
        fits = det > 1e-9 * s[0] ** 3
        return np.where(fits, top / np.where(fits, det, 1.0), t[0] / s[0])


def local_quadratic(x: np.ndarray, y: np.ndarray, at: np.ndarray, span: float = SPAN, often: np.ndarray | None = None) -> np.ndarray:
    """Value at each point of a tricube-weighted quadratic fitted to its floor(span n) nearest of the points (x, y), x in order.

    Where a window has too few distinct x for a quadratic, the weighted mean is taken. often: how many points each (x, y) stands for.
    """
    return LocalQuadratic(x, y, span, often)(np.asarray(at, dtype=float))


def stabilised_variance(expr: DataFrame, gene: str = "gene_idx", spot: str = "spot", value: str = "value", span: float = SPAN) -> DataFrame:
    """(gene, mean, variance, score): the variance of each gene's values over the standard deviation expected at its mean, values clipped
    at mean + sd sqrt(n).

    One aggregation gives the moments; log variance is fitted on log mean once for each distinct mean, in tasks; a second pass over the
    expression sums the clipped values. Constant genes score 0. A ValueError where the means are too few to fit.
    """
    found, n = gene_moments(expr, gene, spot, value)
    genes = stored(found, "gene-moments")
    fitted = genes.where("variance > 0 and mean > 0").select(gene, F.log10("mean").alias("x"), F.log10("variance").alias("y"))
    # genes of one mean differ in y alone, of which a fit takes the mean: a row for each distinct mean
    means = stored(fitted.groupBy("x").agg(F.count("*").alias("n"), F.avg("y").alias("y")), "gene-means")
    points = means.toPandas().sort_values("x")
    if len(points) < LEAST_MEANS:
        raise ValueError(f"{len(points)} distinct means are too few for a local fit")
    x, y, often = (points[c].to_numpy() for c in ("x", "y", "n"))

    def run(parts):
        fit = LocalQuadratic(x, y, span, often)
        for part in parts:
            yield pd.DataFrame({"x": part["x"], "fit": fit(part["x"].to_numpy())})

    fits = means.select("x").repartition("x").mapInPandas(run, "x double, fit double")
    sd = F.pow(F.lit(10.0), F.col("fit") / 2)
    expected = stored(genes.join(fitted.join(fits, "x").select(gene, "fit"), gene).select(gene, "mean", sd.alias("sd"), (F.col("mean") + sd * F.sqrt(F.lit(float(n)))).alias("top")), "gene-fits")
    clipped = F.least(F.col(value).cast("double"), F.col("top"))
    sums = expr.join(expected, gene).groupBy(gene).agg(F.sum(clipped).alias("s"), F.sum(clipped * clipped).alias("q"))
    m, size = F.col("mean"), F.lit(float(n))
    score = (size * m * m + F.col("q") - 2 * m * F.col("s")) / ((size - 1) * F.col("sd") * F.col("sd"))
    scored = sums.join(expected, gene).select(gene, score.alias("score"))
    return genes.join(scored, gene, "left").select(gene, "mean", "variance", F.coalesce("score", F.lit(0.0)).alias("score"))


def binned_dispersion(expr: DataFrame, gene: str = "gene_idx", spot: str = "spot", value: str = "value", bins: int = BINS) -> DataFrame:
    """(gene, mean, variance, score): z of the log dispersion (variance / mean) among the genes of the same of `bins` equal bins of log1p mean.

    values are counts, not logarithms. A gene alone in its bin scores 1; one without dispersion has no score (null).
    """
    genes, _ = gene_moments(expr, gene, spot, value)
    m = F.when(F.col("mean") == 0, 1e-12).otherwise(F.col("mean"))
    rows = stored(genes.select(gene, "mean", "variance", F.log1p(m).alias("x"), F.when(F.col("variance") > 0, F.log(F.col("variance") / m)).alias("d")), "dispersions")
    ends = rows.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    step = (F.col("high") - F.col("low")) / bins
    bin_ = F.when(F.col("high") > F.col("low"), F.greatest(F.ceil((F.col("x") - F.col("low")) / step), F.lit(1))).otherwise(F.lit(1)).cast("int")
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("bin", bin_)
    stats = placed.groupBy("bin").agg(F.avg("d").alias("centre"), F.stddev_samp("d").alias("spread"))
    # without a spread the bin holds one gene
    z = F.when(F.col("spread").isNull() & F.col("d").isNotNull(), F.lit(1.0)).otherwise(F.try_divide(F.col("d") - F.col("centre"), F.col("spread")))
    return placed.join(F.broadcast(stats), "bin").select(gene, "mean", "variance", z.alias("score"))


def top_genes(scores: DataFrame, n: int, gene: str = "gene_idx") -> DataFrame:
    """scores with highly_variable: the n of largest score, ties by gene; genes without a score come last."""
    chosen = scores.where("score is not null").orderBy(F.desc("score"), gene).limit(n).select(gene, F.lit(True).alias("highly_variable"))
    return scores.join(chosen, gene, "left").withColumn("highly_variable", F.coalesce("highly_variable", F.lit(False)))


def variable_genes(expr: DataFrame, n_top: int = 3000, gene: str = "gene_idx", spot: str = "spot", value: str = "value") -> DataFrame:
    """(gene, mean, variance, score, highly_variable), at most all genes but one; by stabilised variance, or by dispersion where that has
    too few means to be fitted."""
    n = max(0, min(n_top, expr.select(gene).distinct().count() - 1))
    try:
        scores = stabilised_variance(expr, gene, spot, value)
    except ValueError:
        scores = binned_dispersion(expr, gene, spot, value)
    return top_genes(scores, n, gene)
