"""Distribution fits per condition and gene: moments as aggregations, likelihood fits as Arrow functions on bounded groups."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .places import adjusted


def median(c: Column | str) -> Column:
    return F.percentile(c, F.lit(0.5))


def size_factors(expr: DataFrame, by: list[str], spot: str = "spot", value: str = "value") -> DataFrame:
    """(by, spot, library, size_factor): totals over the median total of the group (1 if that is 0)."""
    lib = expr.groupBy(*by, spot).agg(F.sum(value).alias("library"))
    mid = F.percentile("library", F.lit(0.5)).over(W.partitionBy(*by))
    return lib.withColumn("size_factor", F.coalesce(F.try_divide("library", mid), F.lit(1.0)))


def log_library(lib: DataFrame, by: list[str]) -> DataFrame:
    log = F.log(F.greatest("library", F.lit(1.0)))
    return lib.groupBy(*by).agg(F.avg(log).alias("mean"), F.coalesce(F.stddev_samp(log), F.lit(0.0)).alias("sd"))


def gamma_moments(expr: DataFrame, by: list[str], value: str = "value", floor: float = 1e-8) -> DataFrame:
    """(by, mean, var, shape, scale, zero_rate): gamma by moments."""
    agg = expr.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.greatest(F.coalesce(F.var_samp(value), F.lit(0.0)), F.lit(floor)).alias("var"), F.avg((F.col(value) == 0).cast("int")).alias("zero_rate"))
    m = F.greatest("mean", F.lit(floor))
    return agg.select(*by, "n", "mean", "var", (m * m / F.col("var")).alias("shape"), (F.col("var") / m).alias("scale"), "zero_rate")


def negative_binomial_moments(expr: DataFrame, by: list[str], value: str = "value", low: float = 1e-3, high: float = 1e6) -> DataFrame:
    """(by, mean, theta, zero_rate): theta = mean^2 / (var - mean), within bounds; the upper one without overdispersion."""
    agg = expr.groupBy(*by).agg(F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"), F.avg((F.col(value) == 0).cast("int")).alias("zero_rate"))
    over = F.col("var") - F.col("mean")
    theta = F.when(over > 0, F.least(F.greatest(F.col("mean") * F.col("mean") / over, F.lit(low)), F.lit(high))).otherwise(high)
    return agg.select(*by, "mean", theta.alias("theta"), "zero_rate")


def common_dispersion(expr: DataFrame, by: list[str], gene: str, value: str = "value") -> DataFrame:
    """Median over genes of the positive (var - mean) / mean^2."""
    g = expr.groupBy(*by, gene).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v")).where("m > 0 and v > m")
    return g.groupBy(*by).agg(median((F.col("v") - F.col("m")) / (F.col("m") * F.col("m"))).alias("dispersion"))


def mad(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """1.4826 times the median absolute deviation."""
    mid = df.withColumn("_m", F.percentile(value, F.lit(0.5)).over(W.partitionBy(*by)))
    return mid.groupBy(*by).agg((median(F.abs(F.col(value) - F.col("_m"))) * 1.4826).alias("mad"))


def winsorised(df: DataFrame, by: list[str], value: str, q: float) -> DataFrame:
    w = W.partitionBy(*by)
    return df.withColumn(value, F.least(F.greatest(F.col(value), F.percentile(value, F.lit(q)).over(w)), F.percentile(value, F.lit(1 - q)).over(w)))


def calibrated(generated: DataFrame, train: DataFrame, gene: str, spot: str, q_gene: float, q_library: float, value: str = "value") -> DataFrame:
    """Generated values capped at the gene's quantile in train, then rows over train's library quantile scaled down to it."""
    caps = train.groupBy(gene).agg(F.percentile(value, F.lit(q_gene)).alias("_cap"))
    top = train.groupBy(spot).agg(F.sum(value).alias("_l")).agg(F.percentile("_l", F.lit(q_library))).first()[0]
    capped = generated.join(caps, gene).withColumn(value, F.least(F.greatest(value, F.lit(0.0)), "_cap"))
    total = F.sum(value).over(W.partitionBy(spot))
    return capped.withColumn(value, F.when(total > top, F.col(value) * top / total).otherwise(F.col(value))).drop("_cap")


def library_scaled(expr: DataFrame, spot: str, target: Column | float, value: str = "value") -> DataFrame:
    t = F.lit(target) if not isinstance(target, Column) else target
    return expr.withColumn(value, F.col(value) * t / (F.sum(value).over(W.partitionBy(spot)) + 1e-8))


def rank_sums(df: DataFrame, gene: str, group: str, value: str = "value", places: int = 6) -> DataFrame:
    """Per gene: fractions expressed in and out of the group, log fold change, and the Wilcoxon z with ties corrected.

    group: boolean column. Values are counted by distinct value before they are ranked.
    """
    at = df.groupBy(gene, value).agg(F.count_if(F.col(group)).alias("a"), F.count_if(~F.col(group)).alias("b"))
    w = W.partitionBy(gene).orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    n = F.col("a") + F.col("b")
    at = at.withColumn("below", F.coalesce(F.sum(n).over(w), F.lit(0))).withColumn("rank", F.col("below") + (n + 1) / 2)
    v = F.col(value)
    agg = at.groupBy(gene).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.sum(F.col("a") * F.col("rank")).alias("r"), F.sum(n * n * n - n).alias("ties"), F.sum(F.when(v > 0, F.col("a")).otherwise(0)).alias("pa"), F.sum(F.when(v > 0, F.col("b")).otherwise(0)).alias("pb"), F.sum(F.col("a") * v).alias("sa"), F.sum(F.col("b") * v).alias("sb")).where("na > 0 and nb > 0")
    na, nb = F.col("na").cast("double"), F.col("nb").cast("double")
    N = na + nb
    mean = na * (N + 1) / 2
    var = na * nb / 12 * ((N + 1) - F.col("ties") / (N * (N - 1)))
    z = F.coalesce(F.try_divide(F.col("r") - mean, F.sqrt(var)), F.lit(0.0))
    fold = F.log((F.col("sa") / na + 1e-9) / (F.col("sb") / nb + 1e-9))
    return agg.select(gene, F.round(F.col("pa") / na, places).alias("in_fraction"), F.round(F.col("pb") / nb, places).alias("out_fraction"), F.round(fold, places).alias("log_fold"), F.round(z, places).alias("z"))


def with_p_values(ranked: DataFrame, places: int = 9) -> DataFrame:
    """Two-sided normal p of z and its Benjamini-Hochberg adjustment over all rows (one a gene)."""

    @F.pandas_udf("double")
    def tail(z: pd.Series) -> pd.Series:
        return z.map(lambda x: math.erfc(abs(x) / math.sqrt(2)))

    p = ranked.withColumn("p", F.round(tail("z"), places))
    return adjusted(p, "p", ranked.columns[0]).withColumn("p_adjusted", F.round("p_adjusted", places))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function of positive numbers: Stirling's series, small ones moved up by the recurrence."""
    x = np.asarray(x, dtype=float)
    small = x < 10
    z = np.where(small, x + 10, x)
    series = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    low = np.where(small, x, 1.0)
    return series - np.where(small, np.log(np.prod([low + k for k in range(10)], axis=0)), 0.0)


def nb_loglik(y: np.ndarray, mean: float, theta: float, count: np.ndarray | float = 1.0) -> float:
    return float((count * (_lgamma(y + theta) - math.lgamma(theta) - _lgamma(y + 1) + theta * math.log(theta / (theta + mean)) + y * math.log(max(mean, 1e-12) / (theta + mean)))).sum())


def poisson_loglik(y: np.ndarray, rate: float, count: np.ndarray | float = 1.0) -> float:
    return float((count * (y * math.log(max(rate, 1e-12)) - rate - _lgamma(y + 1))).sum())


def _inflated(loglik_positive: float, n_zero: float, n: float, p0: float, zero: float) -> float:
    """Log likelihood with extra zeros p0, given that of the positive values and the base law's chance of zero."""
    return n_zero * math.log(max(p0 + (1 - p0) * zero, 1e-300)) + (n - n_zero) * math.log(max(1 - p0, 1e-300)) + loglik_positive


def zip_loglik(y: np.ndarray, rate: float, count: np.ndarray | float = 1.0) -> float:
    """Zero-inflated Poisson; the extra zeros are those beyond what the rate gives."""
    rate, zero, often = max(rate, 1e-10), y == 0, np.broadcast_to(count, y.shape)
    n, n_zero, base = float(often.sum()), float(often[zero].sum()), math.exp(-rate)
    p0 = min(max((n_zero / max(n, 1) - base) / max(1 - base, 1e-12), 1e-12), 1 - 1e-12)
    return _inflated(poisson_loglik(y[~zero], rate, often[~zero]), n_zero, n, p0, base)


def zinb_loglik(y: np.ndarray, mean: float, theta: float, logit: float, count: np.ndarray | float = 1.0) -> float:
    """Zero-inflated NB with extra zeros of the given logit."""
    mean, theta, zero, often = max(mean, 1e-10), max(theta, 1e-10), y == 0, np.broadcast_to(count, y.shape)
    base = math.exp(theta * math.log(theta / (theta + mean)))
    return _inflated(nb_loglik(y[~zero], mean, theta, often[~zero]), float(often[zero].sum()), float(often.sum()), 1 / (1 + math.exp(-logit)), base)


def _golden(f, low: float, high: float, rounds: int = 60) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(rounds):
        if fc > fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2


def fit_counts(y: np.ndarray, count: np.ndarray | None = None) -> dict[str, dict[str, float]]:
    """Maximum likelihood of the Poisson, NB, ZIP and ZINB laws: mean, theta, p0, loglik of each. count: how often each y occurs (once)."""
    y = np.maximum(np.rint(y), 0)
    count = np.ones(len(y)) if count is None else np.asarray(count, dtype=float)
    n, n_zero = float(count.sum()), float(count[y == 0].sum())
    m = float((count * y).sum()) / n
    positive, often = y[y > 0], count[y > 0]
    out = {"poisson": {"mean": m, "theta": math.inf, "p0": 0.0, "loglik": poisson_loglik(y, m, count)}}
    theta = math.exp(_golden(lambda t: nb_loglik(y, m, math.exp(t), count), math.log(1e-3), math.log(1e6))) if m > 0 else 1e6
    out["nb"] = {"mean": m, "theta": theta, "p0": 0.0, "loglik": nb_loglik(y, m, theta, count)}
    if n_zero and len(positive):
        mp = float((often * positive).sum() / often.sum())

        def best_p0(zero):
            return min(max((n_zero / n - zero) / max(1 - zero, 1e-12), 0.0), 1.0)

        def zip_ll(rate):
            zero = math.exp(-rate)
            return _inflated(poisson_loglik(positive, rate, often), n_zero, n, best_p0(zero), zero)

        rate = _golden(zip_ll, max(m, 1e-6), max(mp, 1e-6) + 1e-6)
        out["zip"] = {"mean": rate, "theta": math.inf, "p0": best_p0(math.exp(-rate)), "loglik": zip_ll(rate)}

        def zinb_ll(mean, theta):
            zero = math.exp(theta * math.log(theta / (theta + mean)))
            return _inflated(nb_loglik(positive, mean, theta, often), n_zero, n, best_p0(zero), zero)

        mean, th = max(m, 1e-6), theta
        for _ in range(8):
            mean = _golden(lambda x: zinb_ll(x, th), max(m, 1e-6), max(mp, 1e-6) * 1.5 + 1e-6, 40)
            th = math.exp(_golden(lambda t: zinb_ll(mean, math.exp(t)), math.log(1e-3), math.log(1e6), 40))
        out["zinb"] = {"mean": mean, "theta": th, "p0": best_p0(math.exp(th * math.log(th / (th + mean)))), "loglik": zinb_ll(mean, th)}
    return out


def choose_law(fits: dict[str, dict[str, float]], gain: float = 1.92) -> str:
    """The simplest law which no richer one betters by `gain` in log likelihood for each parameter more."""
    best = "poisson"
    for name, more in (("nb", 1), ("zip", 1), ("zinb", 2)):
        if name in fits and fits[name]["loglik"] - fits["poisson"]["loglik"] > gain * more and fits[name]["loglik"] - fits[best]["loglik"] > (gain if best != "poisson" else 0):
            best = name
    return best


def counted(expr: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, value, n): how often each whole value from 0 on occurs in each group."""
    whole = F.greatest(F.rint(value), F.lit(0.0)).cast("long")
    return expr.groupBy(*by, whole.alias("value")).agg(F.count("*").alias("n"))


def with_absent(counts: DataFrame, by: list[str], spots: DataFrame, within: list[str]) -> DataFrame:
    """counts of sparse rows, and as many zeros as spots (within, n_spots) have no row; groups that occur nowhere in `within` have none."""
    missing = counts.groupBy(*by).agg(F.sum("n").alias("n")).join(spots, within).select(*by, F.lit(0).cast("long").alias("value"), (F.col("n_spots") - F.col("n")).alias("n"))
    return counts.unionByName(missing.where("n > 0")).groupBy(*by, "value").agg(F.sum("n").alias("n"))


def fit_counted(counts: DataFrame, by: list[str], law: str | None = None) -> DataFrame:
    """(by, law, mean, theta, p0, loglik) of rows of counted(): the law asked for, or else the one chosen.

    A group goes to one Arrow batch as its distinct values, not its rows. Where there is no inflated fit (no zeros, or nothing else) the law
    without inflation stands in: Poisson for `zip`, NB for `zinb`.
    """
    kinds = dict(counts.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fits = fit_counts(pdf["value"].to_numpy(dtype=float), pdf["n"].to_numpy(dtype=float))
        name = law or choose_law(fits)
        name = name if name in fits else {"zip": "poisson", "zinb": "nb"}[name]
        f = fits[name]
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), name, f["mean"], f["theta"] if math.isfinite(f["theta"]) else None, f["p0"], f["loglik"]]], columns=[*by, "law", "mean", "theta", "p0", "loglik"])

    return counts.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", law string, mean double, theta double, p0 double, loglik double")


def fit_laws(expr: DataFrame, by: list[str], value: str = "value", law: str | None = None) -> DataFrame:
    """(by, law, mean, theta, p0, loglik): the chosen law for each group (or the one named), fitted on counted values."""
    return fit_counted(counted(expr, by, value), by, law)


#: Newton steps of the zero-inflated Poisson rate; they fall to the root from above and double their places.
ZIP_ROUNDS = 30


def fit_zip(expr: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """(by, law, rate, p0, kernel): the zero-inflated Poisson law by one aggregation and columns alone.

    The rate solves rate = m (1 - exp(-rate)), m the mean of the positive values; zeros beyond exp(-rate) are the inflation. Without any
    the law is Poisson. kernel: log likelihood without the factorials.
    """
    whole = F.greatest(F.rint(value), F.lit(0.0))
    agg = expr.groupBy(*by).agg(F.count("*").cast("double").alias("n"), F.count_if(whole == 0).cast("double").alias("zeros"), F.sum(whole).alias("total"))
    m = F.coalesce(F.try_divide("total", F.col("n") - F.col("zeros")), F.lit(0.0))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(ZIP_ROUNDS)), m, lambda r, _: r - (r - m * (1 - F.exp(-r))) / (1 - m * F.exp(-r)))
    root = agg.withColumn("root", F.when(m > 1, solved))
    p0 = (F.col("zeros") / F.col("n") - F.exp(-F.col("root"))) / (1 - F.exp(-F.col("root")))
    fit = root.withColumn("p0", F.greatest(F.coalesce(p0, F.lit(0.0)), F.lit(0.0))).withColumn("rate", F.when(F.col("p0") > 0, F.col("root")).otherwise(F.col("total") / F.col("n")))
    zero = F.col("zeros") * F.ln(F.greatest(F.col("p0") + (1 - F.col("p0")) * F.exp(-F.col("rate")), F.lit(1e-300)))
    rest = (F.col("n") - F.col("zeros")) * (F.ln(1 - F.col("p0")) - F.col("rate")) + F.col("total") * F.ln(F.greatest("rate", F.lit(1e-12)))
    return fit.select(*by, F.when(F.col("p0") > 0, "zip").otherwise("poisson").alias("law"), "rate", "p0", (zero + rest).alias("kernel"))


def fit_domains(expr: DataFrame, domain: str, gene: str, spots: DataFrame, least: int = 2, value: str = "value") -> DataFrame:
    """(domain, gene, n_nonzero, law, mean, theta, p0, loglik): laws of each gene in each domain by itself.

    expr may leave out zeros; spots: (domain, n_spots). A gene with fewer than `least` positive values in a domain has the law `zero` there.
    """
    by = [domain, gene]
    counts = with_absent(counted(expr, by, value), by, spots.select(domain, "n_spots"), [domain])
    size = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("value") > 0, F.col("n"))), F.lit(0)).alias("n_nonzero"))
    fits = fit_counted(counts.join(size.where(F.col("n_nonzero") >= least), by, "left_semi"), by)
    none = {"law": F.lit("zero"), "mean": F.lit(0.0), "theta": F.lit(None).cast("double"), "p0": F.lit(1.0), "loglik": F.lit(0.0)}
    seen = F.col("law").isNotNull()
    return size.join(fits, by, "left").select(*by, "n_nonzero", *(F.when(seen, F.col(c)).otherwise(other).alias(c) for c, other in none.items()))


def dropout_curves(expr: DataFrame, by: list[str], gene: str, value: str = "value") -> DataFrame:
    """(by, x0, k, n_genes): the logistic curve of the share of zeros on the log mean, over the genes of each group.

    Means and shares come by aggregation; a batch holds a row a gene. Genes without a positive value have no log mean and are left out.
    """
    rates = expr.groupBy(*by, gene).agg(F.avg(value).alias("_mean"), F.avg((F.col(value) == 0).cast("double")).alias("_zero")).where("_mean > 0")
    kinds = dict(rates.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x0, k = fit_dropout(pdf["_mean"].to_numpy(), pdf["_zero"].to_numpy())
        return pd.DataFrame([[*(pdf[c].iloc[0] for c in by), x0, k, len(pdf)]], columns=[*by, "x0", "k", "n_genes"])

    return rates.groupBy(*by).applyInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", x0 double, k double, n_genes long")


def fit_dropout(means: np.ndarray, zeros: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(x0, k) of zero_rate = 1 / (1 + exp(k (log mean - x0))), by damped Gauss-Newton."""
    x, x0, k = np.log(np.maximum(means, 1e-9)), float(np.median(np.log(np.maximum(means, 1e-9)))), 1.0
    loss, damp = np.inf, 1e-2
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(k * (x - x0), -50, 50)))
        r = zeros - p
        now = float(r @ r)
        s = p * (1 - p)
        j = np.stack([s * k, -s * (x - x0)], axis=1)
        step = np.linalg.solve(j.T @ j + damp * np.eye(2), j.T @ r)
        x0, k = x0 + step[0], k + step[1]
        if abs(loss - now) < 1e-12:
            break
        damp = damp * 0.7 if now < loss else damp * 2
        loss = now
    return float(x0), float(k)
