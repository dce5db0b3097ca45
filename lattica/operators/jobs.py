"""Clustering jobs: one for each slice and seed, all of them in one pass a round, and only those that are not yet done."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.bundle import stored
from ..sources.package import committed, read_packages, write_package
from .ranking import top_k

#: Entries of all centres that a pass sends to its tasks (16 MB); slices beyond that are clustered in later passes.
CENTRE_ENTRIES = 2_000_000
ROUNDS = 20


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the first of equals."""
    step = max(1, CENTRE_ENTRIES // centres.size)
    return np.concatenate([((x[i : i + step, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(x), step)])


def _groups(batch: pa.RecordBatch):
    """(group, row numbers, matrix of the vectors) of each group in a batch (group, vector, ...)."""
    names, at = np.unique(np.asarray(batch.column(0).to_pylist(), dtype=object).astype(str), return_inverse=True)
    x = np.stack(batch.column(1).to_numpy(zero_copy_only=False))
    for g, name in enumerate(names.tolist()):
        rows = np.nonzero(at == g)[0]
        yield name, rows, x[rows]


def _summed(rows: DataFrame, centres: dict, dim: int) -> dict:
    """{(group, seed): (rows, sums)} by centre: sums of each task, added up by a grouping."""

    def run(batches):
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            for name, _, x in _groups(batch):
                for seed, c in centres[name].items():
                    at = _nearest(x, c)
                    n, s = sums.setdefault((name, seed), (np.zeros(len(c), dtype=np.int64), np.zeros(c.shape)))
                    n += np.bincount(at, minlength=len(c))
                    np.add.at(s, at, x)
        for (name, seed), (n, s) in sums.items():
            k = len(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * k), pa.array([seed] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(n), pa.array(list(s), pa.list_(pa.float64()))], ["g", "seed", "c", "n", "s"])

    part = rows.select("g", "v").mapInArrow(run, "g string, seed int, c int, n long, s array<double>")
    total = part.groupBy("g", "seed", "c").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(i))) for i in range(dim))).alias("s"))
    out = {job: (np.zeros(len(c)), np.zeros(c.shape)) for job, c in (((g, seed), c) for g, of in centres.items() for seed, c in of.items())}
    for r in total.collect():  # a row for each centre of the pass
        n, s = out[r["g"], r["seed"]]
        n[r["c"]], s[r["c"]] = r["n"], r["s"]
    return out


def kmeans_jobs(rows: DataFrame, by: str, key: str, vector: str, k: int, seeds: list[int], rounds: int = ROUNDS, entries: int = CENTRE_ENTRIES) -> DataFrame:
    """(by, key, cluster_seed, pred_cluster): k-means of each group for each seed, by Lloyd's rounds over all groups and seeds at once.

    A job starts from the k rows (all, if there are fewer) whose hash with the seed is least, so it depends neither on the partitions nor on what other
    jobs run beside it. A round is one pass over the rows; tasks send sums by centre. Rounds end when no centre moves. A centre without rows
    stays where it is. The centres of a pass are bounded by `entries`: with more groups there are more passes, each over its own groups. Rows with a
    null group, key or vector are left out; vectors have one length; groups are compared as text.
    """
    kind = dict(rows.dtypes)[key]
    rows = rows.select(F.col(by).cast("string").alias("g"), F.col(vector).cast("array<double>").alias("v"), F.col(key).alias("key")).where("g is not null and v is not null and key is not null")
    rows = stored(rows, "cluster-rows")
    groups = sorted(r[0] for r in rows.select("g").distinct().collect())  # names of slices
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0
    at_once = max(1, entries // max(1, len(seeds) * k * dim))
    out = None
    for i in range(0, len(groups), at_once):
        some = rows.where(F.col("g").isin(groups[i : i + at_once]))
        seeded = some.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
        order = F.md5(F.concat_ws("||", "seed", F.col("key").cast("string")))
        first = top_k(seeded.withColumn("_h", order), ["g", "seed"], [F.col("_h"), F.col("key")], k).select("g", "seed", "_h", "key", "v").collect()  # the centres of a pass
        centres: dict = {}
        for r in sorted(first, key=lambda r: (r["g"], r["seed"], r["_h"], r["key"])):
            centres.setdefault(r["g"], {}).setdefault(r["seed"], []).append(r["v"])
        centres = {g: {s: np.array(c) for s, c in of.items()} for g, of in centres.items()}
        for _ in range(rounds):
            moved = 0.0
            for (g, s), (n, total) in _summed(some, centres, dim).items():
                new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres[g][s])
                moved = max(moved, float(np.abs(new - centres[g][s]).max()))
                centres[g][s] = new
            if moved < 1e-12:
                break

        def run(batches, centres=centres):
            for batch in batches:
                if not batch.num_rows:
                    continue
                for name, at, x in _groups(batch):
                    keys = batch.column(2).take(pa.array(at))
                    for seed, c in centres[name].items():
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), keys, pa.array([seed] * len(at), pa.int32()), pa.array(_nearest(x, c), pa.int32())], ["g", "key", "seed", "c"])

        found = some.mapInArrow(run, f"g string, key {kind}, seed int, c int")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.select("g", "key", F.lit(0).alias("seed"), F.lit(0).alias("c")).limit(0)
    return out.select(F.col("g").alias(by), F.col("key").alias(key), F.col("seed").alias("cluster_seed"), F.col("c").alias("pred_cluster"))


def pending_jobs(spark: SparkSession, rows: DataFrame, root: str, by: str, seeds: list[int]) -> dict[tuple[int, ...], list[str]]:
    """{seeds: slices} that no committed run below root has; the manifests name the jobs of each run."""
    done = {(g, s) for m in committed(spark, f"{root}/run-*") for g, s in m["info"]["jobs"]}
    todo: dict[tuple[int, ...], list[str]] = {}
    for g in sorted(str(r[0]) for r in rows.select(by).where(F.col(by).isNotNull()).distinct().collect()):  # names of slices
        if left := tuple(s for s in seeds if (g, s) not in done):
            todo.setdefault(left, []).append(g)
    return todo


def cluster_missing(spark: SparkSession, rows: DataFrame, root: str, by: str, key: str, vector: str, k: int, seeds: list[int], rounds: int = ROUNDS, info: dict | None = None) -> int:
    """Clusters every slice with every seed that no run below root has yet, and commits the rows of each run as a package; how many jobs it did.

    Rows keep their other columns. A run that is killed has no manifest, so its jobs are done again and its rows are never read.
    """
    n = 0
    for left, groups in pending_jobs(spark, rows, root, by, seeds).items():
        some = rows.where(F.col(by).cast("string").isin(groups))
        found = kmeans_jobs(some, by, key, vector, k, list(left), rounds)
        result = some.drop(vector).join(found.withColumn(by, F.col(by).cast(dict(rows.dtypes)[by])), [by, key])
        jobs = [[g, s] for g in groups for s in left]
        write_package(spark, f"{root}/run-{uuid.uuid4().hex}", {"spatial_clusters": result}, (info or {}) | {"jobs": jobs, "k": k, "rounds": rounds})
        n += len(jobs)
    return n


def clusters(spark: SparkSession, root: str) -> DataFrame | None:
    """The rows of all committed runs below root; None without any."""
    return read_packages(spark, f"{root}/run-*", "spatial_clusters")
