"""Patch sums, coordinates and recipes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import coordinates as Z
from lattica.operators import histology as H
from lattica.operators import recipes as R


def test_patches_across_tiles_and_borders(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 255, (37, 23, 3))
    pixels = spark.createDataFrame([("i", r, c, *(int(v) for v in image[r, c])) for r in range(37) for c in range(23)], "image string, row int, col int, c0 int, c1 int, c2 int")
    sums = {(r.row, r.col): (r.c0, r.c1, r.c2) for r in H.summed_area(pixels, ["c0", "c1", "c2"], tile=8).collect()}
    want = image.cumsum(axis=0).cumsum(axis=1)
    assert all(sums[r, c] == tuple(want[r, c]) for r in range(37) for c in range(23))
    places = [(0, 0), (36, 22), (7, 8), (18, 11), (8, 0), (60, 5)]
    spots = spark.createDataFrame([("i", k, *p) for k, p in enumerate(places)], "image string, spot int, row int, col int")
    for beta in (1, 3, 9, 49):
        h = round(beta / 2)
        got = {r.spot: r for r in H.patch_means(spots, pixels, ["c0", "c1", "c2"], "spot", beta, tile=8).collect()}
        for k, (r, c) in enumerate(places):
            part = image[max(0, r - h) : min(37, r + h + 1), max(0, c - h) : min(23, c + h + 1)]
            if part.size:
                assert [got[k].c0, got[k].c1, got[k].c2] == pytest.approx(part.reshape(-1, 3).mean(axis=0).tolist())
            else:
                assert got[k].c0 is None
    flat = H.histology_axis(spark.createDataFrame([("i", 1, 2.0, 3.0)], "image string, spot int, a double, b double"), ["a", "b"], "spot")
    assert flat.first().grey is None


def test_mixture_draws(spark):
    parts = [(0.7, np.array([0.0, 0.0]), np.array([[1.0, 0.5], [0.5, 2.0]])), (0.2, np.array([30.0, -10.0]), np.eye(2) * 0.25), (0.1, np.array([-40.0, 5.0]), np.array([[4.0, -1.0], [-1.0, 1.0]]))]
    shares = Z.sampling_weights(np.array([0.7, 0.2, 0.1]))
    assert shares == pytest.approx(np.array([0.1, 0.1, 0.1]) / 0.3)
    got = Z.sampled_from_mixture(spark.range(30000).withColumnRenamed("id", "key"), parts, "key").toPandas()
    for k, (_, mean, cov) in enumerate(parts):
        own = got[got.component == k][["x", "y"]].to_numpy()
        assert len(own) / 30000 == pytest.approx(shares[k], abs=0.01)
        assert np.abs(own.mean(axis=0) - mean).max() < 5 * np.sqrt(cov.max() / len(own))
        assert np.abs(np.cov(own.T) - cov).max() < 0.08 * cov.max()
    whole = Z.sampled_from_mixture(spark.range(5000).withColumnRenamed("id", "key"), parts, "key", mode="uniform").groupBy("component").count().collect()
    assert {r.component: round(r["count"] / 5000, 1) for r in whole} == {0: 0.7, 1: 0.2, 2: 0.1}


def test_cascade(spark):
    ref = spark.createDataFrame([("r1", "s0", "A", 1.0, 1.0), ("r2", "s0", "A", 1.0, 1.0), ("r3", "s0", "B", 5.0, 5.0), ("r4", "s1", "A", 9.0, 9.0)], "k string, slice_id string, label string, x double, y double")
    rows = spark.createDataFrame([("a", "s0", "A"), ("b", "s0", "B"), ("c", "s0", None), ("d", None, "A"), ("e", "s9", "Z")], "k string, slice_id string, label string")
    got = {r.k: r for r in Z.near_references(rows, ref, "k", least=2).collect()}
    assert {k: r.coord_source for k, r in got.items()} == {"a": "label", "b": "slice", "c": "slice", "d": "jitter", "e": "jitter"}
    assert abs(got["a"].x - 1) < 1e-4
    none = Z.near_references(rows, ref.limit(0), "k").collect()
    assert len(none) == 5 and all(r.x is None for r in none)


def test_wrong_orders_raise_before_spark(spark):
    given = {"expr.counts", "obs.label"}
    assert "view" in R.check(R.SPOTS, given)
    for wrong, what in (
        ([("normalise", {}), ("filter", {"min_spots": 1, "min_genes": 1})], "step 2: 'filter' needs"),
        ([("select_genes", {"n": 3})], "expr.log"),
        ([("split_none", {}), R.split_step("spots", "supervised")], "obs.label"),
        ([("nothing", {})], "not known"),
        (R.SAMPLES, "obs.group"),
    ):
        with pytest.raises(ValueError, match=what):
            R.prepared(wrong, {}, given)
    with pytest.raises(ValueError, match="no split"):
        R.split_step("spots", "other")
    obs = spark.createDataFrame([(1, "L", "x")], "spot int, label string, slice_id string")
    got = R.prepared([R.split_step("spots", "unsupervised")], {"obs": obs}, given)["obs"]
    assert got.columns == ["spot", "slice_id", "split"] and got.where(F.col("split") == "all").count() == 1
