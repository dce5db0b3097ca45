"""Projections, alignment and set operations of the typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .places import numbered


def selected_genes(expr: DataFrame, genes: DataFrame, gene: str = "gene_idx") -> DataFrame:
    """Expression of highly variable genes; all of it if none is flagged."""
    flagged = genes.where("highly_variable").select(gene)
    return expr.join(flagged, gene, "left_semi") if flagged.limit(1).count() else expr


def aligned_genes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(gene, old_a, old_b, gene_idx): genes of both tables, numbered in the order of the first."""
    both = a.select("gene", F.col("gene_idx").alias("old_a")).join(b.select("gene", F.col("gene_idx").alias("old_b")), "gene")
    return numbered(both, ["old_a", "gene"], "gene_idx").withColumn("gene_idx", F.col("gene_idx").cast("int"))


def text_columns(df: DataFrame) -> DataFrame:
    """Every string column with nulls as ''."""
    return df.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def synthetic_rows(reference: DataFrame, counts: DataFrame, generator: str, by: list[str], position: str) -> DataFrame:
    """counts.n rows for each group, named generator_<group>_<i>, each with a reference row as source, taken in turns.

    The reference is numbered by position within its group; rows join on i modulo the group's size.
    """
    w = W.partitionBy(*by)
    ref = reference.withColumn("_at", F.row_number().over(w.orderBy(position)) - 1).withColumn("_n", F.count("*").over(w))
    rows = counts.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("i"))
    sizes = ref.select(*by, "_n").distinct()
    joined = rows.join(sizes, by).withColumn("_at", (F.col("i") % F.col("_n")).cast("int")).drop("_n").join(ref.select(*by, "_at", F.col("obs_name").alias("source_obs_name"), "x", "y"), [*by, "_at"])
    token = F.translate(F.concat_ws("_", F.lit(generator), *(F.col(c) for c in by), F.col("i").cast("string")), "/ ", "--")
    return joined.drop("_at").withColumn("synthetic_id", token).withColumn("generator", F.lit(generator))


def reindexed(values: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """values in the keys of target; an error on keys that are repeated or missing."""
    from .contracts import duplicates

    for name, df in (("values", values), ("target", target)):
        if duplicates(df, key).limit(1).count():
            raise ValueError(f"repeated keys in {name}")
    if target.join(values, key, "left_anti").limit(1).count():
        raise ValueError("target keys without a value")
    return target.join(values, key)


def matched_barcodes(raw: DataFrame, patches: DataFrame, name: str, sample: Column) -> DataFrame:
    """patches (name, patch_idx) with the raw row of the same barcode; raw names may have the prefix <sample>:."""
    plain = raw.withColumn("_b", F.regexp_replace(F.col(name), F.concat(F.lit("^"), sample, F.lit(":")), F.lit("")))
    return patches.select(F.col(name).alias("_b"), "patch_idx").join(plain, "_b").withColumnRenamed("_b", "barcode")


def unique_names(df: DataFrame, name: str, order: list[str]) -> DataFrame:
    """Repeated names get -1, -2, ... in the given order."""
    k = F.row_number().over(W.partitionBy(name).orderBy(*order)) - 1
    return df.withColumn("_k", k).withColumn(name, F.when(F.col("_k") > 0, F.concat_ws("-", F.col(name), F.col("_k").cast("string"))).otherwise(F.col(name))).drop("_k")


def path_context(path: Column) -> dict[str, Column]:
    """model, family, variant and synthetic ratio out of .../<model>/<family>/<variant>[_syn<r>_...]/file."""
    ratio = F.replace(F.regexp_extract(path, r"_syn([0-9]+(?:p[0-9]+)?)(?:_|/)", 1), F.lit("p"), F.lit("."))
    return {"model": F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+/[^/]+$", 1), "family": F.regexp_extract(path, r"([^/]+)/[^/]+/[^/]+$", 1), "variant": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "synthetic_ratio": F.nullif(ratio, F.lit("")).try_cast("double")}
