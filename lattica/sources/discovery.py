"""Which data sets lie below a folder, and which of them count: one listing as a table, path parts as columns, rules in order of precedence."""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def listing(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, parts, name, n_files, bytes): every folder below root that holds data files, as Spark writes them.

    parts are the names of its folders below root, of key=value folders the value; name is the last of them. Contents are not read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root).select("path", "length")
    below = "^.*?" + re.escape(urlparse(root).path.rstrip("/")) + "/?"
    folders = files.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).groupBy("folder").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
    parts = F.filter(F.transform(F.split(F.regexp_replace("folder", below, ""), "/"), lambda p: F.regexp_replace(p, "^[^=]*=", "")), lambda p: p != "")
    return folders.select(F.col("folder").alias("path"), parts.alias("parts"), F.coalesce(F.get(parts, F.size(parts) - 1), F.lit("")).alias("name"), "n_files", "bytes")


def has(part: str) -> Column:
    """Whether one of the parts of a path is this."""
    return F.array_contains("parts", part)


def parent(steps: int = 1) -> Column:
    """The part so many steps above the last one."""
    return F.get("parts", F.size("parts") - 1 - steps)


def above(steps: int = 1) -> Column:
    """The parts without the last ones, joined by slashes."""
    return F.array_join(F.slice("parts", F.lit(1), F.greatest(F.size("parts") - steps, F.lit(0))), "/")


@dataclass
class Rule:
    """Data sets that a rule takes, and the pool they stand for."""

    name: str
    takes: Column
    pool: Column


def selected(found: DataFrame, rules: list[Rule], all_if_none: bool = False) -> DataFrame:
    """found with rule and pool: of the data sets that stand for one pool those of the first rule that takes any, the others are left out.

    A data set is taken by the first rule that fits it. all_if_none: where no rule takes any data set, all are returned (rule null).
    """
    rank, pool = F.lit(None).cast("int"), F.lit(None).cast("string")
    for k, rule in reversed(list(enumerate(rules))):
        rank, pool = F.when(rule.takes, F.lit(k)).otherwise(rank), F.when(rule.takes, rule.pool).otherwise(pool)
    ranked = found.withColumns({"_rank": rank, "pool": pool})
    taken = ranked.where("_rank is not null").withColumn("_best", F.min("_rank").over(W.partitionBy("pool"))).where("_rank = _best")
    names = F.array(*(F.lit(r.name) for r in rules))
    out = taken.select(*found.columns, F.get(names, F.col("_rank")).alias("rule"), "pool")
    if all_if_none:
        none = taken.agg(F.count("*").alias("_taken"))
        rest = found.crossJoin(F.broadcast(none)).where("_taken = 0").select(*found.columns, F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("pool"))
        out = out.unionByName(rest)
    return out


def not_selected(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """What lies there and does not count."""
    return found.join(chosen.select("path"), "path", "left_anti")


def pool_rules(cohorts_by_slice: list[str], pool: str = "pool_40x") -> list[Rule]:
    """Generated pools. In these cohorts a pool is read from its data sets by slice where it has any (pool/<slice>/synthetic, pool/slices/slice_<id>),
    else whole (pool/synthetic_pool_...); elsewhere always whole."""
    by_slice = F.arrays_overlap("parts", F.array(*(F.lit(c) for c in cohorts_by_slice)))
    folder = (F.col("name") == "synthetic") & (parent(2) == pool) & ~parent().isin("conditions", "slices")
    named = F.col("name").startswith("slice_") & (parent() == "slices") & (parent(2) == pool)
    whole = F.col("name").startswith("synthetic_pool") & (parent() == pool)
    return [Rule("by_slice", by_slice & (folder | named), above(2)), Rule("whole", whole, above(1))]


def slice_rules(pool: str = "pool_40x") -> list[Rule]:
    """One data set for each slice of a pool: pool/<slice>/synthetic, else pool/slices/slice_<slice>."""
    folder = (F.col("name") == "synthetic") & (parent(2) == pool) & ~parent().isin("conditions", "slices")
    named = F.col("name").startswith("slice_") & (parent() == "slices") & (parent(2) == pool)
    return [Rule("folder", folder, F.concat(above(2), F.lit("|"), parent())), Rule("slices", named, F.concat(above(2), F.lit("|"), F.regexp_replace("name", "^slice_", "")))]


def of(found: DataFrame, cohort: str | None = None, models: list[str] | None = None) -> DataFrame:
    """Those whose paths have the cohort and one of the models among their parts."""
    out = found.where(has(cohort)) if cohort else found
    return out.where(F.arrays_overlap("parts", F.array(*(F.lit(m) for m in models)))) if models else out


def slice_files(found: DataFrame, tag: str, models: list[str] | None = None, slices: list[str] | None = None, pool: str = "pool_40x") -> DataFrame:
    """The slices (slice_id) of the pools of a split: <model>/<tag>/pool/slices/slice_<id>."""
    out = of(found, tag, models).where(F.col("name").startswith("slice_") & (parent() == "slices") & (parent(2) == pool) & (parent(3) == tag)).withColumn("slice_id", F.regexp_replace("name", "^slice_", ""))
    return out.where(F.col("slice_id").isin(slices)) if slices is not None else out


def leaves(found: DataFrame, name: str = "synthetic") -> DataFrame:
    """Data sets of this name whose folder holds no other folder and is not the root itself."""
    inner = found.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts") - 1, F.lit(1))), lambda k: F.struct(F.array_join(F.slice("parts", F.lit(1), k), "/").alias("folder"), (F.size("parts") - k).alias("below")))).alias("a"))
    # a folder two or more steps above a data set holds a folder that is no data set itself
    holding = inner.where("a.below > 1").select(F.col("a.folder").alias("_folder")).distinct()
    return found.where((F.col("name") == name) & (F.size("parts") > 1)).withColumn("_folder", above()).join(holding, "_folder", "left_anti").drop("_folder")


#: The part of a path that names the task, and how the reference of such a data set is laid out.
TASKS = ("supervised_low_label", "cross_slice_generalization", "spatial_cluster")


def reference_path(cohorts: list[str], models: list[str], mode: str = "supervised", default_split: str = "fixed") -> Column:
    """Where the real data of a generated data set lie, from its parts: <task>/<cohort>/model_inputs/<model>/..., null if that can't be told."""
    first = lambda names: F.get(F.filter("parts", lambda p: p.isin(names)), F.lit(0))
    start = lambda *prefixes: F.get(F.filter("parts", lambda p: p.rlike("^(" + "|".join(prefixes) + ")")), F.lit(0))
    cohort, model, task = first(cohorts), first(models), first(list(TASKS))
    base = F.concat_ws("/", task, cohort, F.lit("model_inputs"), model)
    low = F.when(start("fraction").isNotNull() & start("seed").isNotNull(), F.concat_ws("/", base, start("fraction"), start("seed")))
    cross = F.concat_ws("/", base, F.coalesce(start("fixed_", "leave_"), F.lit(default_split)))
    other = F.concat_ws("/", cohort, F.lit("model_inputs"), model, F.when(has("unsupervised"), "unsupervised").otherwise(mode))
    path = F.when(task == TASKS[0], low).when(task == TASKS[1], cross).when(task == TASKS[2], F.concat_ws("/", base, F.lit("unsupervised"))).otherwise(other)
    return F.when(cohort.isNotNull() & model.isNotNull(), path)
