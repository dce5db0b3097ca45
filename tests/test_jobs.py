"""Clustering jobs, places in an order, inputs of runs, patches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import fits, jobs, places
from lattica.sources import bundle, package, runs


def lloyd(names, x, k, seed, rounds):
    import hashlib

    start = sorted(range(len(x)), key=lambda i: (hashlib.md5(f"{seed}||{names[i]}".encode()).hexdigest(), names[i]))[:k]
    c = x[start].copy()
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
    for _ in range(rounds):
        at = near()
        for j in range(len(c)):
            if (at == j).any():
                c[j] = x[at == j].mean(axis=0)
    return near()


def blobs(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{i % 3}", f"o{i}", [float(v) for v in rng.normal(4 * (i % 4), 1, 3)]) for i in range(240)]
    rows += [("lone", "only", [1.0, 2.0, 3.0]), ("lone", "no vector", None), (None, "no slice", [0.0, 0.0, 0.0])]
    return rows, spark.createDataFrame(rows, "slice_id string, obs_name string, v array<double>")


@pytest.mark.parametrize("entries", [10**6, 1])
def test_jobs_equal_lloyd(spark, entries):
    """With room for all centres in a pass, and for one group a pass."""
    rows, df = blobs(spark)
    got = {(r.slice_id, r.cluster_seed, r.obs_name): r.pred_cluster for r in jobs.kmeans_jobs(df, "slice_id", "obs_name", "v", 4, [1, 7], 6, entries).collect()}
    want = {}
    for s in ("s0", "s1", "s2", "lone"):
        mine = [r for r in rows if r[0] == s and r[2] is not None]
        for seed in (1, 7):
            for r, c in zip(mine, lloyd([r[1] for r in mine], np.array([r[2] for r in mine]), 4, seed, 6)):
                want[s, seed, r[1]] = int(c)
    assert got == want


def test_jobs_empty(spark):
    _, df = blobs(spark)
    out = jobs.kmeans_jobs(df.limit(0), "slice_id", "obs_name", "v", 4, [1])
    assert out.columns == ["slice_id", "obs_name", "cluster_seed", "pred_cluster"] and out.count() == 0


def test_done_jobs_are_left_out(spark):
    _, df = blobs(spark)
    root = bundle.scratch(spark, "test-jobs")
    args = (root, "slice_id", "obs_name", "v", 3)
    assert jobs.clusters(spark, root) is None
    assert jobs.cluster_missing(spark, df.where("slice_id = 's0'"), *args, [1]) == 1
    assert jobs.pending_jobs(spark, df, root, "slice_id", [1, 2]) == {(1, 2): ["lone", "s1", "s2"], (2,): ["s0"]}
    assert jobs.cluster_missing(spark, df, *args, [1, 2]) == 7
    assert jobs.cluster_missing(spark, df, *args, [1, 2]) == 0
    got = jobs.clusters(spark, root)
    assert got.count() == got.select("slice_id", "obs_name", "cluster_seed").distinct().count() == 2 * 241


def test_places(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), i) for i, v in enumerate(rng.integers(0, 20, 3000))] + [(None, 5000), (7.0, 5001)]
    df = spark.createDataFrame(rows, "v double, k int").repartition(7)
    got = {r.k: r.at for r in places.numbered(df, ["v", "k"], "at", ranges=5).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0.0, r[1]))
    assert got == {k: i for i, (_, k) in enumerate(order)}
    assert places.numbered(df.limit(0), ["v", "k"], "at").count() == 0


def test_sorted_pairs(spark):
    a, b = [3.0, 1.0, 2.0, 9.0], [10.0, 30.0, 20.0]
    side = lambda x: spark.createDataFrame([(v, str(i)) for i, v in enumerate(x)], "v double, k string")
    got = sorted((r.a, r.b) for r in places.sorted_pairs(side(a), side(b), "v", "k").collect())
    assert got == [(1.0, 10.0), (2.0, 20.0), (3.0, 30.0)]


def test_adjusted_p_values(spark):
    import math

    rng = np.random.default_rng(2)
    z = [round(float(v), 4) for v in rng.normal(0, 2, 400)] + [0.0, 0.0, 9.0]
    rows = {r.gene: r for r in fits.with_p_values(spark.createDataFrame(list(enumerate(z)), "gene int, z double")).collect()}
    p = [round(math.erfc(abs(v) / math.sqrt(2)), 9) for v in z]
    order = sorted(range(len(z)), key=lambda i: (p[i], i))
    best, want = 1.0, {}
    for rank in range(len(z), 0, -1):
        i = order[rank - 1]
        best = min(best, p[i] * len(z) / rank)
        want[i] = best
    assert all(rows[i].p == pytest.approx(p[i], abs=1e-9) and rows[i].p_adjusted == pytest.approx(want[i], abs=2e-9) for i in want)


def test_patches_equal_crop(spark):
    rng = np.random.default_rng(4)
    image = rng.integers(1, 100, (21, 13)).astype(float)
    px = spark.createDataFrame([("a", r, c, float(image[r, c])) for r in range(21) for c in range(13)], "image string, row int, col int, value double")
    at = [(0, 0), (20, 12), (7, 8), (8, 7), (10, 0), (25, 5), (90, 90)]
    asked = spark.createDataFrame([(k, "a", r, c) for k, (r, c) in enumerate(at)] + [(99, "none", 1, 1)], "key int, image string, row int, col int")
    got = {r.key: r.pixels for r in runs.cropped(px, asked, 3, tile=8).collect()}
    assert all(got[k] == bundle.crop(image, r, c, 3).ravel().tolist() for k, (r, c) in enumerate(at))
    assert got[99] == [0.0] * 49


def test_embeddings_once(spark):
    p = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(10)], "key int, pixels array<double>")
    root = bundle.scratch(spark, "test-embeddings")
    model = lambda: lambda x: x.sum(axis=1, keepdims=True)
    assert runs.embeddings(spark, root) is None
    assert [runs.embed_missing(spark, p.where(c), root, model, 1) for c in ("key < 4", "true", "true")] == [4, 6, 0]
    assert sorted((r.key, r.embedding[0]) for r in runs.embeddings(spark, root).collect()) == [(k, k + 1.0) for k in range(10)]


def test_paradigm_inputs_check(spark):
    root = bundle.scratch(spark, "test-inputs")
    spots = spark.createDataFrame([("a", "s0", 1.0, 2.0, "synthetic"), ("b", "s0", 0.0, 0.0, "real")], "obs_name string, slice_id string, x double, y double, source string")
    genes = spark.createDataFrame([("g1", 0), ("g2", 1)], "gene string, gene_idx int")
    expr = spark.createDataFrame([("a", 0, 1.0)], "obs_name string, gene_idx int, value double")
    for name, s in (("good", spots.limit(1)), ("bad", spots), ("empty", spots.limit(0))):
        package.write_package(spark, f"{root}/{name}", {"spots": s, "genes": genes, "expr": expr}, {"generator": "gan"})
    out = runs.paradigm_inputs(spark, f"{root}/good", f"{root}/good", "/out", "d", "unsupervised")
    assert out[2] == "/out/spatial_cluster/d/gan/unsupervised" and out[1]["expr"].count() == 1
    with pytest.raises(ValueError, match="'zero_coords': 1, 'not_synthetic': 1"):
        runs.paradigm_inputs(spark, f"{root}/good", f"{root}/bad", "/out", "d", "unsupervised")
    with pytest.raises(ValueError, match="needs synthetic rows"):
        runs.paradigm_inputs(spark, f"{root}/good", f"{root}/empty", "/out", "d", "unsupervised")


def test_inputs_without_labels(spark):
    df = spark.createDataFrame([("s0", "a")], "slice_id string, obs_name string")
    assert runs.clustering_input(df, "s0").count() == 1
    with pytest.raises(ValueError, match="no rows"):
        runs.clustering_input(df, "s9")
    with pytest.raises(ValueError, match="label columns"):
        runs.clustering_input(df.withColumn("layer", F.lit("L1")), "s0")
    root = bundle.scratch(spark, "test-views")
    package.write_package(spark, f"{root}/c", {"data": df.withColumn("layer", F.lit("L1"))})
    runs.write_model_views(spark, root, f"{root}/c", "unsupervised", {"cut": lambda d: d.drop("layer")})
    assert runs.read_model_view(spark, root, "cut", "unsupervised").columns == ["slice_id", "obs_name"]
    with pytest.raises(ValueError, match="label columns"):
        runs.write_model_views(spark, root, f"{root}/c", "unsupervised", {"linked": None})
