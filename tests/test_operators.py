"""Contracts, edge cases and numerics of the library operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import scalars as S
from lattica.operators import contracts as C
from lattica.operators import features as X
from lattica.operators import fits as P
from lattica.operators import metrics as M
from lattica.operators import paradigm, sampling, simulate, spatial, tables
from lattica.sources import bundle
from lattica.streaming import monitor


def test_split_keeps_one_of_each_side(spark):
    df = spark.createDataFrame([(f"o{i}", "a" if i < 9 else "b") for i in range(10)], "obs_name string, label string")
    for share in (0.01, 0.5, 0.99):
        got = {(r[0], r[1]): r[2] for r in sampling.stratified_split(df, ["label"], share, 1, "obs_name").groupBy("label", "split").count().collect()}
        assert got["a", "train"] >= 1 and got["a", "test"] >= 1 and got["b", "train"] == 1


def test_group_folds_keep_groups_whole(spark):
    df = spark.createDataFrame([(i, f"g{i % 7}", f"l{i % 7 % 2}") for i in range(70)], "id int, g string, label string")
    folds = sampling.group_folds(df, "g", "label", 3, 5)
    assert folds.count() == 70 and folds.groupBy("g").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_weights_sum_to_one(spark):
    real = spark.createDataFrame([(f"r{i}", "a") for i in range(4)], "obs_name string, label string")
    syn = spark.createDataFrame([(f"s{i}", "a") for i in range(9)], "obs_name string, label string")
    package = paradigm.builder("weighted_erm")(real, syn, 2.0, 0.3, 1)
    sums = {r[0]: r[1] for r in package.groupBy("augmentation_source").agg(F.sum("loss_weight")).collect()}
    assert math.isclose(sums["real"], 0.7) and math.isclose(sums["synthetic"], 0.3)
    assert paradigm.builder("weighted_erm")(real, syn, 2.0, 0, 1).count() == 4
    with pytest.raises(ValueError):
        paradigm.builder("no such")


def test_contracts(spark):
    df = spark.createDataFrame([("a", None, 1.0, float("nan")), ("a", "s", 0.0, 0.0)], "obs_name string, slice_id string, x double, y double")
    assert {r.rule: r.n for r in C.violations(df, C.spot_rules()).collect()} == {"no_name": 0, "no_slice": 1, "bad_x": 0, "bad_y": 1, "zero_coords": 1}
    assert C.duplicates(df, "obs_name").count() == 1
    with pytest.raises(ValueError):
        C.forbid_labels(df.withColumn("Label", F.lit(1)), "unsupervised")
    with pytest.raises(ValueError):
        C.require_columns(df, "nothing")
    with pytest.raises(ValueError):
        C.training_rows(df.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError):
        tables.reindexed(df.select("obs_name"), df.select("obs_name"), "obs_name")


def test_metrics_of_empty_and_one_class(spark):
    empty = spark.createDataFrame([], "g string, y_true string, y_pred string")
    assert M.classification(empty, ["g"]).count() == 0
    one = spark.createDataFrame([("g", "a", "a")] * 3, "g string, y_true string, y_pred string")
    r = M.classification(one, ["g"]).first()
    assert r.accuracy == 1 and r.macro_f1 == 1 and r.mcc == 0
    auc = M.ranking(one.withColumn("s", F.lit(0.7)), ["g"], F.col("y_true") == "a", F.col("s")).first()
    assert auc.auroc is None and auc.sensitivity == 1
    assert M.agreement(one, ["g"], "y_true", "y_pred").first().ari == 1


def test_constant_correlation_is_zero(spark):
    df = spark.createDataFrame([("g", 1.0, float(i)) for i in range(4)], "g string, a double, b double")
    assert M.safe_corr(df, ["g"], "a", "b").first()["corr"] == 0


def test_radius_join_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(size=(60, 2))
    df = spark.createDataFrame([("s", i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "slice_id string, id int, x double, y double")
    got = {(r.id, r.neighbour) for r in spatial.radius_join(df, df, "slice_id", "id", 0.4).collect()}
    want = {(i, j) for i in range(60) for j in range(60) if ((pts[i] - pts[j]) ** 2).sum() <= 0.16}
    assert got == want


def test_pca_equals_svd(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id int, vec array<double>")
    p = X.pca(df, "vec", 3)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(np.abs(p.components.T), np.abs(vt[:3]), atol=1e-8)
    got = np.array([r.features for r in p.transform(df, "vec").orderBy("id").collect()])
    np.testing.assert_allclose(np.abs(got), np.abs((x - x.mean(axis=0)) @ vt[:3].T), atol=1e-8)


def test_hungarian_equals_brute_force():
    import itertools

    rng = np.random.default_rng(2)
    for shape in ((4, 4), (3, 5), (5, 3)):
        a = rng.integers(0, 20, shape).astype(float)
        got = sum(a[i, j] for i, j in X.hungarian(a))
        b = a if shape[0] <= shape[1] else a.T
        assert got == min(sum(b[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(b.shape[1]), b.shape[0]))


def test_laws_are_recovered():
    rng = np.random.default_rng(4)
    assert P.choose_law(P.fit_counts(rng.poisson(5, 2000))) == "poisson"
    nb = P.fit_counts(rng.poisson(rng.gamma(2, 3, 3000)))
    assert P.choose_law(nb) == "nb" and 1.6 < nb["nb"]["theta"] < 2.5
    z = rng.poisson(6, 3000) * (rng.random(3000) > 0.4)
    fit = P.fit_counts(z)
    assert P.choose_law(fit) == "zip" and abs(fit["zip"]["p0"] - 0.4) < 0.05
    means = np.exp(rng.normal(0, 1.5, 300))
    x0, k = P.fit_dropout(means, 1 / (1 + np.exp(1.3 * (np.log(means) - 0.5))))
    assert abs(x0 - 0.5) < 0.01 and abs(k - 1.3) < 0.01


@pytest.mark.parametrize("name", sorted(simulate.SIMULATORS))
def test_simulators_keep_their_invariants(name):
    rng = np.random.default_rng(5)
    x = rng.poisson(rng.gamma(2, 2, 12)[None, :] * rng.lognormal(0, 0.3, 30)[:, None]).astype(float)
    out = simulate.SIMULATORS[name](x, 80, np.random.default_rng(6))
    assert out.shape == (80, 12) and (out >= 0).all() and out.dtype.kind == "i"
    assert np.percentile(out.sum(axis=1), 95) <= 2.5 * x.sum(axis=1).max() + 12
    assert (out == simulate.SIMULATORS[name](x, 80, np.random.default_rng(6))).all()


def test_ranks_and_rescue():
    assert simulate.rank_placed(np.array([9, 1, 5]), np.array([2.0, 7.0, 1.0])).tolist() == [5, 9, 1]
    out = simulate.rescue_zeros(np.zeros((4, 3), dtype=int), np.array([True, False, True]), np.random.default_rng(0))
    assert out.sum(axis=0).tolist() == [1, 0, 1]


def test_crop_pads_with_zeros():
    image = np.arange(4 * 7 * 3).reshape(4, 7, 3) + 1
    assert (bundle.crop(image, 1, 5, 1) == image[0:3, 4:7]).all()
    edge = bundle.crop(image, 0, 0, 1)
    assert (edge[0] == 0).all() and (edge[1:, 1:] == image[0:2, 0:2]).all()
    assert not bundle.crop(image, 99, 99, 1).any()


def test_sample_vector_length(spark):
    df = spark.createDataFrame([("s", [1.0, 2.0], 0.0, 1.0), ("s", [3.0, 2.0], 1.0, 3.0)], "id string, vec array<double>, x double, y double")
    assert len(X.sample_vector(df, ["id"], "vec", 2, F.lit(1.0)).first().features) == 2 * 2 + 3 * 2 + 6


def test_scalars(spark):
    df = spark.createDataFrame([("  a/b  c__",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(S.safe_token(F.col("t"))).collect()] == ["a_b_c", "value", "value"]
    num = spark.createDataFrame([(2.0,), (0.25,), (None,)], "r double").select(S.variant_id(F.lit("f"), F.col("r"), F.lit(None).cast("double")))
    assert [r[0] for r in num.collect()] == ["f_ratio2", "f_ratio0.25", "f"]


def test_monitor_as_a_stream(spark, tmp_path):
    rows = [(f"2024-01-01 00:{m:02d}:00", "a", "a" if m % 2 else "b") for m in range(30)]
    df = spark.createDataFrame(rows, "t string, y_true string, y_pred string").withColumn("ts", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = monitor.windowed_confusion(stream, "ts", "10 minutes", "1 minute", []).writeStream.outputMode("complete").format("memory").queryName("monitored").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("monitored").collect()}
    assert got == {tuple(r) for r in monitor.windowed_confusion(df, "ts", "10 minutes", "1 minute", []).collect()}
