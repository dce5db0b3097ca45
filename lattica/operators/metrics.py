"""Evaluation metrics as aggregations: counts first, formulas over the few counted rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _null_safe(df: DataFrame, other: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null, keeping one copy of them."""
    named = other.select(*(F.col(c).alias(f"_k_{c}") if c in by else F.col(c) for c in other.columns))
    if not by:
        return df.crossJoin(named)
    cond = None
    for c in by:
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        cond = one if cond is None else cond & one
    return df.join(named, cond, how).drop(*(f"_k_{c}" for c in by))


def confusion(df: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return df.groupBy(*by, truth, pred).agg(F.count("*").alias("n"))


def _by_label(df: DataFrame, by: list[str], truth: str, pred: str) -> DataFrame:
    """Per group and label of truth or prediction: support, predicted, tp. One shuffle of counted rows."""
    counts = confusion(df, by, truth, pred)
    both = counts.select(*by, F.inline(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col(pred).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")))))
    return both.groupBy(*by, "label").agg(*(F.sum(c).alias(c) for c in ("support", "predicted", "tp")))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification(df: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred", places: int = 6) -> DataFrame:
    """n, accuracy, balanced_accuracy (over true labels), macro_f1 and weighted_f1 (over the union of labels), mcc."""
    per = _by_label(df, by, truth, pred).withColumn("f1", _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))
    agg = per.groupBy(*by).agg(
        F.sum("support").alias("n"),
        F.sum("tp").alias("_c"),
        F.avg(F.when(F.col("support") > 0, F.col("tp") / F.col("support"))).alias("balanced_accuracy"),
        F.avg("f1").alias("macro_f1"),
        F.sum(F.col("f1") * F.col("support")).alias("_wf"),
        F.sum(F.col("support") * F.col("predicted")).alias("_tp"),
        F.sum(F.col("predicted") * F.col("predicted")).alias("_pp"),
        F.sum(F.col("support") * F.col("support")).alias("_tt"),
    )
    n = F.col("n")
    cov = (F.col("_c") * n - F.col("_tp")).cast("double")
    norm = F.sqrt((n * n - F.col("_pp")).cast("double") * (n * n - F.col("_tt")).cast("double"))
    out = {"accuracy": F.col("_c") / n, "balanced_accuracy": F.col("balanced_accuracy"), "macro_f1": F.col("macro_f1"), "weighted_f1": F.col("_wf") / n, "mcc": _ratio(cov, norm)}
    return agg.select(*by, "n", *(F.round(v, places).alias(k) for k, v in out.items()))


def per_label(df: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred", places: int = 6) -> DataFrame:
    """Precision, recall, f1 and support of each true label."""
    per = _by_label(df, by, truth, pred).where("support > 0")
    out = {"precision": _ratio(F.col("tp"), F.col("predicted")), "recall": _ratio(F.col("tp"), F.col("support")), "f1": _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))}
    return per.select(*by, "label", "support", *(F.round(v, places).alias(k) for k, v in out.items()))


def ranking(df: DataFrame, by: list[str], truth: Column, score: Column, places: int = 6) -> DataFrame:
    """n, auroc (average ranks), auprc (average precision over thresholds), sensitivity, specificity at 0.5; a null or NaN score is 0.

    AUCs of a group with one class are null. Rows are first counted by distinct score, so the windows run over
    those.
    """
    s = F.when(score.isNull() | F.isnan(score), 0.0).otherwise(score)
    at = df.select(*by, truth.cast("int").alias("t"), s.alias("s")).groupBy(*by, "s").agg(F.sum("t").alias("pos"), F.sum(1 - F.col("t")).alias("neg"))
    up = W.partitionBy(*by).orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    down = W.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(W.unboundedPreceding, W.currentRow)
    at = at.withColumn("neg_below", F.coalesce(F.sum("neg").over(up), F.lit(0))).withColumn("tp", F.sum("pos").over(down)).withColumn("all", F.sum(F.col("pos") + F.col("neg")).over(down))
    agg = at.groupBy(*by).agg(
        F.sum("pos").alias("p"),
        F.sum("neg").alias("q"),
        F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2)).alias("u"),
        F.sum(F.col("pos") * F.col("tp") / F.col("all")).alias("ap"),
        F.sum(F.when(F.col("s") >= 0.5, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("s") < 0.5, F.col("neg")).otherwise(0)).alias("tn"),
    )
    p, q = F.col("p"), F.col("q")
    both = (p > 0) & (q > 0)
    return agg.select(*by, (p + q).alias("n"), F.round(F.when(both, F.col("u") / (p * q)), places).alias("auroc"), F.round(F.when(both, F.col("ap") / p), places).alias("auprc"), F.round(_ratio(F.col("tp"), p), places).alias("sensitivity"), F.round(_ratio(F.col("tn"), q), places).alias("specificity"))


def _entropy(n: Column, total: Column) -> Column:
    return -F.sum(n / total * F.log(n / total))


def agreement(df: DataFrame, by: list[str], truth: str, cluster: str, places: int = 6) -> DataFrame:
    """n, ari, nmi (arithmetic mean), homogeneity, completeness, v_measure, fowlkes_mallows, from the contingency table."""
    cells = confusion(df, by, truth, cluster)
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    total = cells.groupBy(*by).agg(F.sum("n").alias("_total"))
    a = cells.groupBy(*by, truth).agg(F.sum("n").alias("a"))
    b = cells.groupBy(*by, cluster).agg(F.sum("n").alias("b"))
    full = _null_safe(_null_safe(_null_safe(cells, a, [*by, truth]), b, [*by, cluster]), total, by)
    n, N = F.col("n"), F.col("_total")
    joint = full.groupBy(*by).agg(F.max("_total").alias("_total"), pairs("n").alias("sij"), F.sum(n / N * F.log(n * N / (F.col("a") * F.col("b")))).alias("mi"))
    sa = _null_safe(a, total, by).groupBy(*by).agg(pairs("a").alias("sa"), _entropy(F.col("a"), N).alias("ha"))
    sb = _null_safe(b, total, by).groupBy(*by).agg(pairs("b").alias("sb"), _entropy(F.col("b"), N).alias("hb"))
    m = _null_safe(_null_safe(joint, sa, by), sb, by)
    all_pairs = N * (N - 1) / 2
    expected = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), all_pairs), F.lit(0.0))
    top = (F.col("sa") + F.col("sb")) / 2
    mi, ha, hb = F.greatest(F.col("mi"), F.lit(0.0)), F.col("ha"), F.col("hb")
    h, c = F.coalesce(F.try_divide(mi, ha), F.lit(1.0)), F.coalesce(F.try_divide(mi, hb), F.lit(1.0))
    out = {
        "ari": F.coalesce(F.try_divide(F.col("sij") - expected, top - expected), F.lit(1.0)),
        "nmi": F.coalesce(F.try_divide(2 * mi, ha + hb), F.lit(1.0)),
        "homogeneity": h,
        "completeness": c,
        "v_measure": F.coalesce(F.try_divide(2 * h * c, h + c), F.lit(0.0)),
        "fowlkes_mallows": F.coalesce(F.try_divide(F.col("sij"), F.sqrt(F.col("sa") * F.col("sb"))), F.lit(0.0)),
    }
    return m.select(*by, N.alias("n"), *(F.round(v, places).alias(k) for k, v in out.items()))


def spread(df: DataFrame, by: list[str], metrics: list[str], places: int = 6) -> DataFrame:
    """mean, std (sample), median, max, min of each metric, named metric_stat."""
    stats = {"mean": F.avg, "std": F.stddev_samp, "median": lambda c: F.percentile(c, F.lit(0.5)), "max": F.max, "min": F.min}
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(F.round(f(m), places).alias(f"{m}_{k}") for m in metrics for k, f in stats.items()))


def baseline_delta(df: DataFrame, baseline: Column, keys: list[str], metrics: list[str], places: int = 6) -> DataFrame:
    """df with delta_<metric>: the metric less that of the baseline row with the same keys (which may be null)."""
    base = df.where(baseline).groupBy(*keys).agg(*(F.max(m).alias(f"_b_{m}") for m in metrics))
    joined = _null_safe(df, base, keys, "left")
    return joined.select(*df.columns, *(F.round(F.col(m) - F.col(f"_b_{m}"), places).alias(f"delta_{m}") for m in metrics))


def histogram(df: DataFrame, by: list[str], value: Column, top: Column, bins: int, pseudo: float = 1e-8) -> DataFrame:
    """(by, bin, p): shares of `bins` equal bins of 0 to top, the right edge in the last, each count raised by pseudo."""
    cell = F.least(F.floor(F.coalesce(F.try_divide(value * bins, top), F.lit(0.0))), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*by, cell.alias("bin")).agg(F.count("*").alias("n"))
    groups = counts.groupBy(*by).agg(F.sum("n").alias("_total")).select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = _null_safe(groups, counts, [*by, "bin"], "left")
    return filled.select(*by, "bin", ((F.coalesce("n", F.lit(0)) + pseudo) / (F.col("_total") + bins * pseudo)).alias("p"))


def jensen_shannon(p: DataFrame, q: DataFrame, by: list[str], places: int = 6) -> DataFrame:
    """Jensen-Shannon distance (base e) of two tables (by, bin, p)."""
    both = p.withColumnRenamed("p", "a").join(q.withColumnRenamed("p", "b"), [*by, "bin"])
    m = (F.col("a") + F.col("b")) / 2
    return both.groupBy(*by).agg(F.round(F.sqrt(F.greatest(F.sum((F.col("a") * F.log(F.col("a") / m) + F.col("b") * F.log(F.col("b") / m)) / 2), F.lit(0.0))), places).alias("jsd"))


def safe_corr(df: DataFrame, by: list[str], a: str, b: str, places: int = 6) -> DataFrame:
    """Pearson correlation; 0 with fewer than two rows or a constant side."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    agg = df.groupBy(*by).agg(F.count("*").alias("n"), F.covar_pop(x, y).alias("c"), F.stddev_pop(x).alias("sx"), F.stddev_pop(y).alias("sy"))
    ok = (F.col("n") > 1) & (F.col("sx") > 1e-12) & (F.col("sy") > 1e-12)
    return agg.select(*by, "n", F.round(F.when(ok, F.col("c") / (F.col("sx") * F.col("sy"))).otherwise(0.0), places).alias("corr"))


def wasserstein(a: DataFrame, b: DataFrame, by: list[str], value: str, places: int = 6) -> DataFrame:
    """Wasserstein-1 distance of two samples: the area between their distribution functions, over counted distinct values."""
    side = lambda df, k: df.groupBy(*by, value).agg(F.count("*").alias("n")).select(*by, value, F.when(F.lit(k), F.col("n")).otherwise(0).alias("na"), F.when(F.lit(k), 0).otherwise(F.col("n")).alias("nb"))
    both = side(a, True).unionByName(side(b, False)).groupBy(*by, value).agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    group = W.partitionBy(*by)
    running = group.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)
    both = both.withColumn("fa", F.sum("na").over(running) / F.sum("na").over(group)).withColumn("fb", F.sum("nb").over(running) / F.sum("nb").over(group))
    both = both.withColumn("step", F.lead(value).over(group.orderBy(value)) - F.col(value))
    return both.groupBy(*by).agg(F.round(F.sum(F.abs(F.col("fa") - F.col("fb")) * F.col("step")), places).alias("w1"))


def weighted_mean_std(df: DataFrame, by: list[str], value: Column, weight: Column, places: int = 6) -> DataFrame:
    """Weighted mean and population standard deviation."""
    agg = df.groupBy(*by).agg(F.sum(weight).alias("w"), F.sum(weight * value).alias("s"), F.sum(weight * value * value).alias("q"))
    mean = F.col("s") / F.col("w")
    return agg.select(*by, F.round(mean, places).alias("mean"), F.round(F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0))), places).alias("std"))
