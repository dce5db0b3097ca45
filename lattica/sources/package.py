"""Packages: several tables that are committed at once.

The tables of an attempt are written below data/<attempt>; the manifest, one small file with row counts, schemas and checksums of what was written, comes
last. Readers look at manifests alone, so a writer that is killed leaves nothing that anyone reads. A rewrite adds an attempt and a manifest
with the next number; the last one counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def checksum(df: DataFrame) -> tuple[int, str]:
    """(rows, sum of row hashes): the same in whatever order and partitions the rows are."""
    row = df.agg(F.count("*"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in df.columns)).cast("decimal(38,0)"))).first()
    return int(row[0]), str(row[1] or 0)


def committed(spark: SparkSession, path: str) -> list[dict]:
    """The manifests of the package at path, oldest first; none if nothing was ever committed. path may hold wildcards."""
    try:
        rows = spark.read.option("recursiveFileLookup", True).text(f"{path}/manifests", wholetext=True).select("value", "_metadata.file_path").collect()  # one row a commit
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    found = [json.loads(r["value"]) | {"root": r["file_path"].rsplit("/manifests/", 1)[0]} for r in rows]
    return sorted(found, key=lambda m: (m["root"], m["number"], m["attempt"]))


def write_package(spark: SparkSession, path: str, tables: dict[str, DataFrame], info: dict | None = None) -> dict:
    """Writes and commits tables as one package; returns its manifest. info: anything JSON can hold."""
    attempt, entries = uuid.uuid4().hex, {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/data/{attempt}/{name}")
        back = spark.read.schema(df.schema).parquet(f"{path}/data/{attempt}/{name}")
        rows, total = checksum(back)
        entries[name] = {"rows": rows, "checksum": total, "schema": json.loads(df.schema.json())}
    number = max((m["number"] for m in committed(spark, path)), default=0) + 1
    manifest = {"number": number, "attempt": attempt, "tables": entries, "info": info or {}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifests/{number:06d}-{attempt}")
    return manifest


def read_package(spark: SparkSession, path: str, verify: bool = False) -> tuple[dict[str, DataFrame], dict]:
    """(tables, info) as last committed. With verify, tables that do not have the rows of the manifest raise a ValueError."""
    manifests = committed(spark, path)
    if not manifests:
        raise FileNotFoundError(f"no package was committed at {path}")
    last = manifests[-1]
    tables = {n: spark.read.schema(StructType.fromJson(e["schema"])).parquet(f"{path}/data/{last['attempt']}/{n}") for n, e in last["tables"].items()}
    if verify:
        wrong = [n for n, e in last["tables"].items() if checksum(tables[n]) != (e["rows"], e["checksum"])]
        if wrong:
            raise ValueError(f"tables differ from their manifest: {wrong}")
    return tables, last["info"]


def read_packages(spark: SparkSession, pattern: str, name: str) -> DataFrame | None:
    """The rows of one table of all packages whose paths match, as last committed; None without any."""
    last = {m["root"]: m for m in committed(spark, pattern)}
    if not last:
        return None
    schema = StructType.fromJson(next(iter(last.values()))["tables"][name]["schema"])
    return spark.read.schema(schema).parquet(*(f"{root}/data/{m['attempt']}/{name}" for root, m in last.items()))


def write_training_package(spark: SparkSession, root: str, family: str, variant: str, manifest: dict, train: DataFrame | None = None, pretrain: DataFrame | None = None, finetune: DataFrame | None = None) -> str:
    """The tables of a training variant at root/family/variant; its path. Synthetic rows to pretrain on and real ones to finetune on are parts of their own."""
    tables = {n: df for n, df in (("train", train), ("pretrain_synthetic", pretrain), ("finetune_real", finetune)) if df is not None}
    if not tables:
        raise ValueError("a training package needs a table")
    write_package(spark, path := f"{root}/{family}/{variant}", tables, manifest | {"paradigm_family": family, "variant_id": variant})
    return path


#: Settings of a variant that stand beside each clustered row.
PROVENANCE = ("dataset", "mode", "task_name", "alpha", "selection_policy", "condition_source", "coord_source", "coord_policy", "training_regime", "n_real_used", "n_synthetic_used", "input_mode")


def cluster_result(rows: DataFrame, manifest: dict, ablation: str, backend: str, seed: int, source: str = "augmentation_source") -> DataFrame:
    """rows (obs_name, slice_id, x, y, pred_cluster and more) with the counts of their slice and the settings they were clustered with.

    Rows without a source column are real. Settings that the manifest has not are left out, but for the model, family, variant and ratios of a baseline.
    """
    rows = rows if source in rows.columns else rows.withColumn(source, F.lit("real"))
    synthetic = F.coalesce(F.col(source) == "synthetic", F.lit(False))
    counts = rows.groupBy("slice_id").agg(F.count("*").alias("n_obs"), F.count_if(~synthetic).alias("n_real"), F.count_if(synthetic).alias("n_synthetic"))
    fixed = {"ablation": ablation, "downstream_backend": backend, "cluster_seed": seed, "model": manifest.get("generator", manifest.get("model", "baseline"))}
    fixed |= {k: manifest.get(k, v) for k, v in (("paradigm_family", "real_only"), ("variant_id", "real_only"), ("synthetic_ratio", 0.0), ("real_fraction", 1.0))}
    fixed |= {k: manifest[k] for k in PROVENANCE if k in manifest}
    named = rows.withColumnsRenamed({"x": "spatial_x", "y": "spatial_y"}).withColumn("pred_cluster", F.col("pred_cluster").cast("string"))
    return named.join(counts, "slice_id").withColumns({k: F.lit(v) for k, v in fixed.items()})


def split_tables(rows: DataFrame, train: list[str], test: list[str], tag: str) -> dict[str, DataFrame]:
    """data (rows of the train and test slices with split and split_tag), summary (rows of each split, slice and label) and index (names and splits)."""
    if both := set(train) & set(test):
        raise ValueError(f"slices in train and test: {sorted(both)}")
    asked = F.col("slice_id").isin([*train, *test])
    if missing := {*train, *test} - {r[0] for r in rows.where(asked).select("slice_id").distinct().collect()}:  # as many as were asked for
        raise ValueError(f"no rows of the slices {sorted(missing)}")
    data = rows.where(asked).withColumns({"split": F.when(F.col("slice_id").isin(train), "train").otherwise("test"), "split_tag": F.lit(tag)})
    summary = data.groupBy("split", "slice_id", "label").agg(F.count("*").alias("n_spots"))
    return {"data": data, "summary": summary, "index": data.select("obs_name", "slice_id", "label", "split", "split_tag")}
