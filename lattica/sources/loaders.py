"""Readers with rules of their own: labels, splits, alphas, many samples, two modalities; and what is kept apart when labels are dropped."""

from __future__ import annotations

import re
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import LABEL_LIKE, forbid_labels, require_columns
from .package import read_package, write_package


def _csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, whatever they look like."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def evaluation_labels(spark: SparkSession, path: str) -> DataFrame:
    """(obs_name, label) of a label file: those columns if it has both, else its first column and `label`, or its last column without that."""
    df = _csv(spark, path)
    if {"obs_name", "label"} <= set(df.columns):
        return df.select("obs_name", "label")
    label = "label" if "label" in df.columns else df.columns[-1]
    return df.select(F.col(f"`{df.columns[0]}`").alias("obs_name"), F.col(f"`{label}`").alias("label"))


def cluster_results(spark: SparkSession, root: str, name: str = "spatial_clusters.csv") -> DataFrame:
    """The rows of every cluster table called `name` below root, as text, with `parts`, the folders it lies in.

    A table may be a file of that name or a folder of files, as Spark writes it; of key=value folders the part is the value. Other files
    are listed, not read; the columns are those of the first table. The driver holds the paths, as Spark's readers do.
    """
    paths = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    inside = f"/([^/=]*=)?{re.escape(name)}(/[^/]*)?$"
    found = [r.path for r in paths.where(F.col("path").rlike(inside)).collect()]
    if not found:
        raise FileNotFoundError(f"no {name} below {root}")
    below = "^.*?" + re.escape(urlparse(root).path.rstrip("/")) + "/?"
    rows = spark.read.option("header", True).option("inferSchema", False).option("recursiveFileLookup", True).csv(found)
    folder = F.regexp_replace(F.regexp_replace(F.col("_metadata.file_path"), inside, ""), below, "")
    return rows.withColumn("parts", F.transform(F.split(folder, "/"), lambda p: F.regexp_replace(p, "^[^=]*=", "")))


def split_table(spark: SparkSession, path: str) -> DataFrame:
    """A split file; sample_id and split are text, so that 007 stays 007."""
    return require_columns(_csv(spark, path), "sample_id", "split")


def regional_alphas(spark: SparkSession, path: str | None) -> DataFrame:
    """(region, alpha) of a file with region_id and alpha; no rows without a file. An alpha that is no number raises when it is read."""
    if path is None:
        return spark.createDataFrame([], "region string, alpha double")
    df = require_columns(_csv(spark, path), "region_id", "alpha")
    return df.select(F.col("region_id").alias("region"), F.col("alpha").cast("double").alias("alpha"))


def split_data(spark: SparkSession, path: str, name: str = "data") -> DataFrame:
    """The rows of a committed split, with all that a training step relies on; a ValueError names what is missing."""
    return require_columns(read_package(spark, path)[0][name], "obs_name", "slice_id", "label", "split", "x", "y")


def common_columns(spark: SparkSession, paths: dict[str, str], keep: list[str], sample: str = "sample") -> DataFrame:
    """Rows of many wide tables with the columns they all have, in the first one's order, and the name of the table. Only schemas are compared, and only
    these columns are scanned."""
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    shared = set.intersection(*(set(df.columns) for df in tables.values()))
    columns = [c for c in next(iter(tables.values())).columns if c in shared]
    if lacking := [c for c in keep if c not in columns]:
        raise ValueError(f"not all tables have {lacking}")
    out = None
    for name, df in tables.items():
        part = df.select(F.lit(name).alias(sample), *(f"`{c}`" for c in columns))
        out = part if out is None else out.unionByName(part)
    return out


def two_modalities(rna: DataFrame, annotation: DataFrame, protein: DataFrame | None = None, key: str = "barcode") -> DataFrame:
    """Annotated rows that have expression, with their protein vector where there is one: (annotation columns, rna, protein, has_protein)."""
    both = annotation.join(rna.select(key, F.col("vector").alias("rna")), key)
    if protein is None:
        return both.withColumns({"protein": F.lit(None).cast("array<double>"), "has_protein": F.lit(False)})
    return both.join(protein.select(key, F.col("vector").alias("protein")), key, "left").withColumn("has_protein", F.col("protein").isNotNull())


def without_labels(df: DataFrame, path: str, key: str = "obs_name") -> DataFrame:
    """df without the columns that tell a label; they are committed at path, for evaluation alone, with the key. Without any, nothing is written."""
    told = [c for c in df.columns if c.lower() in {x.lower() for x in LABEL_LIKE}]
    if not told:
        return df
    write_package(df.sparkSession, path, {"labels": df.select(key, *told)}, {"columns": told})
    return df.drop(*told)


def unsupervised_slices(df: DataFrame) -> DataFrame:
    """(slice_id) of the rows an unsupervised generator trains on: split train, or all where no row is train. Label columns or missing ones raise."""
    require_columns(forbid_labels(df, "unsupervised"), "obs_name", "slice_id", "split", "x", "y")
    some = df.agg(F.max((F.col("split") == "train").cast("int")).alias("_train"))
    wanted = F.when(F.col("_train") == 1, "train").otherwise("all")
    return df.crossJoin(F.broadcast(some)).where(F.col("split") == wanted).select("slice_id").distinct()


def of_one_slice(rows: DataFrame, path: str = "path") -> DataFrame:
    """The rows of those data sets (by path) whose rows are all of one slice; these can be merged slice by slice."""
    single = rows.groupBy(path).agg(F.count_distinct("slice_id").alias("_n"), F.count_if(F.col("slice_id").isNull()).alias("_none")).where("_n = 1 and _none = 0")
    return rows.join(single.select(path), path, "left_semi")


def label_condition(mode, label, checkpoint):
    """Column struct(label, strategy, error): what a generated label may be trusted to be.

    checkpoint: struct(label_condition, label_strategy, conditional, conditional_key, condition_classes, classifier_key, classifier_classes). The label asked for
    must be that of the checkpoint where it has one. Without the supervised mode or any label there is no condition; else the checkpoint must be
    trained on the label, be conditional on labels that include it, or have a classifier of labels that include it.
    """
    own = checkpoint["label_condition"]
    wanted = F.coalesce(label, own)
    clash = F.coalesce(label != own, F.lit(False))
    inside = lambda classes, key: F.coalesce((checkpoint[key] == "label") & F.array_contains(checkpoint[classes], wanted), F.lit(False))
    strategy = (
        F.when(checkpoint["label_strategy"] == "label_wise_generation", checkpoint["label_strategy"])
        .when(F.coalesce(checkpoint["conditional"], F.lit(False)) & inside("condition_classes", "conditional_key"), "conditional_generation")
        .when(inside("classifier_classes", "classifier_key"), "classifier_guidance")
    )
    asked = (mode == "supervised") & wanted.isNotNull()
    error = F.when(clash, "label is not the checkpoint's").when(asked & strategy.isNull(), "no trusted condition")
    good = asked & error.isNull()
    return F.struct(F.when(good, wanted).alias("label"), F.when(good, strategy).alias("strategy"), error.alias("error"))
