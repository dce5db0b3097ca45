"""Filters, quality control and contract checks of the typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that tell a label; none may be in the input of an unsupervised step.
LABEL_LIKE = ("label", "labels", "cell_type", "cluster", "layer", "ground_truth", "domain", "annotation", "spatialLIBD")
UNLABELLED = ("", "nan", "NaN", "unknown")


def quality_filter(expr: DataFrame, min_spots: int, min_genes: int, spot: str = "spot", gene: str = "gene_idx", value: str = "value") -> DataFrame:
    """Genes seen in min_spots spots first, then spots with min_genes of those genes; the order matters."""
    seen = expr.where(F.col(value) > 0)
    genes = seen.groupBy(gene).agg(F.countDistinct(spot).alias("_n")).where(F.col("_n") >= min_spots).select(gene)
    kept = expr.join(genes, gene, "left_semi")
    spots = kept.where(F.col(value) > 0).groupBy(spot).agg(F.countDistinct(gene).alias("_n")).where(F.col("_n") >= min_genes).select(spot)
    return kept.join(spots, spot, "left_semi")


def varying_genes(expr: DataFrame, gene: str = "gene_idx", value: str = "value", least: float = 1e-8) -> DataFrame:
    return expr.join(expr.groupBy(gene).agg(F.var_pop(value).alias("_v")).where(F.col("_v") > least).select(gene), gene, "left_semi")


def ranged(expr: DataFrame, by: str, value: str, of: str, totals: tuple[float, float], numbers: tuple[int, int]) -> DataFrame:
    """Rows of groups (cells or genes) whose total and whose number of positive entries of `of` lie within the ranges."""
    agg = expr.groupBy(by).agg(F.sum(value).alias("_t"), F.count_distinct(F.when(F.col(value) > 0, F.col(of))).alias("_n"))
    return expr.join(agg.where(F.col("_t").between(*totals) & F.col("_n").between(*numbers)).select(by), by, "left_semi")


def without_prefixes(df: DataFrame, name: str, prefixes: tuple[str, ...] = ("ERCC", "MT-")) -> DataFrame:
    return df.where(~reduce(lambda a, b: a | b, (F.col(name).startswith(p) for p in prefixes)))


def labelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.where(F.col(label).isNotNull() & ~F.col(label).isin(*UNLABELLED))


def training_rows(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows of split train, else of split all; an error if there are neither."""
    found = {r[0] for r in df.select(split).where(F.col(split).isin("train", "all")).distinct().collect()}
    if not found:
        raise ValueError("no row has split 'train' or 'all'")
    return df.where(F.col(split) == ("train" if "train" in found else "all"))


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def forbid_labels(df: DataFrame, mode: str) -> DataFrame:
    found = [c for c in df.columns if c.lower() in {x.lower() for x in LABEL_LIKE}]
    if mode == "unsupervised" and found:
        raise ValueError(f"label columns in an unsupervised input: {found}")
    return df


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each rule, in one pass."""
    agg = df.agg(*(F.count_if(F.coalesce(c, F.lit(True))).alias(k) for k, c in rules.items()))
    return agg.select(F.inline(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules))))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def spot_rules() -> dict[str, Column]:
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return {"no_name": F.col("obs_name").isNull() | (F.col("obs_name") == ""), "no_slice": F.col("slice_id").isNull(), "bad_x": bad("x"), "bad_y": bad("y"), "zero_coords": (F.col("x") == 0) & (F.col("y") == 0)}


def same_order(a: DataFrame, b: DataFrame, position: str, name: str) -> DataFrame:
    """Places at which two ordered gene tables differ."""
    both = a.select(position, F.col(name).alias("left")).join(b.select(position, F.col(name).alias("right")), position, "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def one_value(df: DataFrame, *columns: str) -> DataFrame:
    """Error unless each column has one value."""
    n = df.agg(*(F.count_distinct(c).alias(c) for c in columns)).first()
    many = [c for c in columns if n[c] != 1]
    if many:
        raise ValueError(f"not one value in {many}")
    return df


def some_rows(df: DataFrame | None, what: str) -> DataFrame:
    """df; error if there is none or it has no row."""
    if df is None or df.isEmpty():
        raise ValueError(f"{what} needs synthetic rows of the same slice")
    return df


def fixed_run(given: dict[str, list], fixed: dict[str, list]) -> dict[str, list]:
    """The given settings of a run; error if one of the fixed ones is absent or has other values (compared as text)."""
    other = [k for k, v in fixed.items() if [str(x) for x in given.get(k, [])] != [str(x) for x in v]]
    if other:
        raise ValueError(f"settings of a final run differ: {other}")
    return given


def disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that both sides have; must be empty for a clean train/test split."""
    return a.select(key).intersect(b.select(key))


def common_genes(expr: DataFrame, sample: str, gene: str) -> DataFrame:
    """Genes that all samples have, in order."""
    n = expr.select(sample).distinct().count()
    return expr.groupBy(gene).agg(F.count_distinct(sample).alias("_n")).where(F.col("_n") == n).select(gene)
