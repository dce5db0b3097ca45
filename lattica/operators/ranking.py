"""Best variants, top-k and parameter responses. Windows with a rank limit keep k rows a group before they shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first k rows of each group; order must end in a unique key."""
    return df.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_k") <= k).drop("_k")


def best_detail(detail: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of detail whose keys, which may be null, are among the best."""
    named = best.select(*(F.col(c).alias(f"_k_{c}") for c in keys)).distinct()
    cond = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        cond = one if cond is None else cond & one
    return detail.join(named, cond, "left_semi")


def best_by_each(df: DataFrame, by: list[str], metrics: list[str], tie: list[str]) -> DataFrame:
    """For each metric the best row of each group, as (by, metric, value, tie columns); nulls are passed over."""
    long = df.select(*by, *tie, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics)))).where("value is not null")
    return top_k(long, [*by, "metric"], [F.desc("value"), *(F.col(t) for t in tie)])


def complete_variants(df: DataFrame, variant: list[str], slice_: str, expected: int, baseline: Column, most_ratio: float | None = None) -> DataFrame:
    """Rows of variants that cover all expected slices; the baseline stays always; ratios above most_ratio go."""
    if most_ratio is not None:
        df = df.where(F.col("ratio").isNull() | (F.col("ratio") <= most_ratio))
    full = df.groupBy(*variant).agg(F.countDistinct(slice_).alias("_n")).where(F.col("_n") >= expected)
    return df.where(baseline).unionByName(best_detail(df.where(~baseline), full, variant))


def ratio_windows(agg: DataFrame, metric: str, width: int = 10, least: int = 1, most: int = 40) -> DataFrame:
    """Per (model, classifier): the best ratio of each split, their rounded mean, and the window of `width` ratios around it within bounds."""
    best = top_k(agg.where(F.col("ratio").isNotNull()), ["model", "classifier", "split_tag"], [F.desc(metric), F.col("ratio")])
    centre = best.groupBy("model", "classifier").agg(F.bround(F.avg("ratio")).cast("int").alias("center"))
    start = F.greatest(F.least(F.col("center") - width // 2, F.lit(most - width + 1)), F.lit(least))
    return centre.select("model", "classifier", "center", F.array_join(F.sequence(start, start + width - 1).cast("array<string>"), ",").alias("weighted_ratio_window"))
