"""Variable genes against numpy; packages that are killed; an evaluation that is stopped and goes on."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import metrics as M
from lattica.operators import variable as V
from lattica.sources import package as K
from lattica.streaming import evaluation as E


def brute_scores(x: np.ndarray) -> np.ndarray:
    """The clipped, standardised variance of each column; the local quadratic by least squares over the nearest 30 %."""
    n, genes = x.shape
    mean, var = x.mean(axis=0), x.var(axis=0, ddof=1)
    ok = var > 0
    lx, ly = np.log10(mean[ok]), np.log10(var[ok])
    fit = []
    for p in lx:
        d = np.abs(lx - p)
        h = np.sort(d)[int(0.3 * len(lx)) - 1]
        w = np.sqrt(np.where(d < h, (1 - np.minimum(d / h, 1) ** 3) ** 3, 0))
        fit.append(np.linalg.lstsq(np.vander(lx - p, 3, increasing=True) * w[:, None], ly * w, rcond=None)[0][0])
    sd = 10 ** (np.array(fit) / 2)
    clipped = np.minimum(x[:, ok], mean[ok] + sd * np.sqrt(n))
    out = np.zeros(genes)
    out[ok] = ((clipped - mean[ok]) ** 2).sum(axis=0) / ((n - 1) * sd**2)
    return out


def test_stabilised_variance_equals_numpy(spark):
    rng = np.random.default_rng(0)
    rate = np.exp(rng.normal(0.5, 1.2, 60))
    x = rng.poisson(rate * rng.gamma(2, 0.5, (80, 60))).astype(float)
    x[:, 7] = 3.0
    x[0, 9] = 4000.0
    rows = [(s, g, float(x[s, g])) for s in range(80) for g in range(60) if x[s, g]]
    df = spark.createDataFrame(rows, "spot int, gene_idx int, value double")
    got = {r.gene_idx: r for r in V.stabilised_variance(df).collect()}
    want = brute_scores(x[:, sorted(got)])
    for k, g in enumerate(sorted(got)):
        assert got[g].score == pytest.approx(want[k], rel=1e-7, abs=1e-12)
        assert got[g].variance == pytest.approx(x[:, g].var(ddof=1), rel=1e-9, abs=1e-12)
    chosen = {r.gene_idx for r in V.variable_genes(df, 10).where("highly_variable").collect()}
    assert chosen == {g for _, g in sorted((-got[g].score, g) for g in got)[:10]}


def point_by_point(x, y, at, span):
    """The local quadratic by its definition, a window at a time; numbers of the quadratic come from least squares."""
    q, out = max(1, int(span * len(x))), []
    for p in at:
        d = np.abs(x - p)
        h = np.sort(d)[q - 1]
        inside = d < h if h > 0 else d <= 0
        w = (1 - (d[inside] / (h or 1.0)) ** 3) ** 3
        if len(np.unique(x[inside])) < 3:
            out.append((w * y[inside]).sum() / w.sum())
            continue
        root = np.sqrt(w)
        out.append(np.linalg.lstsq(np.vander((x[inside] - p) / h, 3, increasing=True) * root[:, None], y[inside] * root, rcond=None)[0][0])
    return np.array(out)


def test_local_quadratic_in_blocks_equals_its_definition():
    rng = np.random.default_rng(4)
    for x in (np.sort(rng.normal(0, 1, 3000)), np.sort(rng.gamma(0.3, 2, 1201)), np.repeat(np.sort(rng.normal(0, 1, 150)), rng.integers(1, 40, 150)), np.repeat([0.0, 1.0, 2.0, 5.0], [400, 30, 200, 1])):
        y = np.sin(x) + rng.normal(0, 0.3, len(x))
        distinct, where, often = np.unique(x, return_inverse=True, return_counts=True)
        mean = np.bincount(where, y) / often
        for span in (0.3, 0.02, 1.0):
            want = point_by_point(x, y, distinct, span)
            assert V.local_quadratic(x, y, distinct, span) == pytest.approx(want, rel=1e-8, abs=1e-9)
            assert V.local_quadratic(distinct, mean, distinct, span, often) == pytest.approx(want, rel=1e-8, abs=1e-9)


def test_local_fits_of_many_genes_take_little_time():
    rng = np.random.default_rng(5)
    x = np.sort(rng.normal(0, 1, 200_000))
    began = time.process_time()
    got = V.local_quadratic(x, x * x, x[::10])
    assert got == pytest.approx(x[::10] ** 2, abs=1e-9) and time.process_time() - began < 60  # windows of 60,000 points


def test_too_few_means_fall_back(spark):
    df = spark.createDataFrame([(s, g, float(1 + s * g * g % 7)) for s in range(9) for g in range(4)], "spot int, gene_idx int, value double")
    with pytest.raises(ValueError, match="too few"):
        V.stabilised_variance(df)
    got = V.variable_genes(df, 2).collect()
    assert sum(r.highly_variable for r in got) == 2 and len(got) == 4
    assert V.variable_genes(df.where("false"), 2).count() == 0


def test_killed_writer_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    one = spark.createDataFrame([(1, "a"), (2, None)], "n int, s string")
    broken = one.withColumn("s", F.when(F.col("n") == 2, F.raise_error(F.lit("killed"))).otherwise(F.col("s")))
    with pytest.raises(Exception, match="killed"):
        K.write_package(spark, path, {"data": one, "index": broken})
    assert os.path.isdir(f"{path}/data") and K.committed(spark, path) == []
    with pytest.raises(FileNotFoundError):
        K.read_package(spark, path)
    K.write_package(spark, path, {"data": one, "index": one}, {"tag": 1})
    with pytest.raises(Exception, match="killed"):
        K.write_package(spark, path, {"data": one.limit(0), "index": broken})
    tables, info = K.read_package(spark, path, verify=True)
    assert info == {"tag": 1} and sorted(map(tuple, tables["data"].collect()), key=str) == [(1, "a"), (2, None)]
    K.write_package(spark, path, {"data": one.where("n = 1")}, {"tag": 2})
    assert [tuple(r) for r in K.read_package(spark, path)[0]["data"].collect()] == [(1, "a")]
    attempt = K.committed(spark, path)[-1]["attempt"]
    one.write.mode("append").parquet(f"{path}/data/{attempt}/data")
    with pytest.raises(ValueError, match="data"):
        K.read_package(spark, path, verify=True)


def test_splits_and_provenance(spark):
    rows = spark.createDataFrame([("a", "s0", "L", 0.0, 1.0, 3), ("b", "s1", "L", 0.0, 1.0, 4)], "obs_name string, slice_id string, label string, x double, y double, pred_cluster int")
    with pytest.raises(ValueError, match="train and test"):
        K.split_tables(rows, ["s0"], ["s0"], "t")
    with pytest.raises(ValueError, match="s9"):
        K.split_tables(rows, ["s0"], ["s9"], "t")
    got = K.cluster_result(rows, {}, "none", "pca", 1).collect()
    assert {(r.model, r.variant_id, r.n_obs, r.n_real, r.n_synthetic, r.pred_cluster) for r in got} == {("baseline", "real_only", 1, 1, 0, "3"), ("baseline", "real_only", 1, 1, 0, "4")}


def test_evaluation_goes_on_where_it_ended(spark, tmp_path):
    root, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    fields = "obs_name string, y_true string, y_pred string, score double"
    good = "obs_name,y_true,y_pred,score\na,x,x,0.5\nb,x,y,0.25\n"
    texts = {"m1/p.csv": good, "m2/p.csv": good.replace("0.25", "much"), "m3/p.csv": "\n", "m4/p.csv": "obs_name,y_true,y_pred,score\n", "m5/p.csv": good, "m6/p.csv": good, "m7/p.csv": good.replace("y_pred", "guess")}
    for name, text in texts.items():
        os.makedirs(f"{root}/{os.path.dirname(name)}", exist_ok=True)
        open(f"{root}/{name}", "w").write(text)
    known = spark.createDataFrame([(f"m{k}",) for k in (1, 2, 3, 4, 6, 7)], "reference string")

    def run(**more):
        return E.evaluate_files(spark, root, out, mark, fields, lambda p: F.regexp_extract(p, "/(m[0-9])/", 1), known, lambda r: M.classification(r, ["path"]), files_at_once=2, **more)

    assert run(most=2) == 2
    assert E.evaluations(spark, out).count() == 4
    # the last batch was flushed, but the run ended before it was noted: it comes again
    done = sorted(os.listdir(f"{mark}/commits"), key=lambda n: (len(n), n))
    os.remove(f"{mark}/commits/{[n for n in done if not n.startswith('.')][-1]}")
    run()
    got = {r.reference: (r.status, r.reason, r.n, r.accuracy) for r in E.evaluations(spark, out).collect()}
    assert E.evaluations(spark, out).count() == 7
    assert got["m1"] == ("ok", "", 2, 0.5) and got["m6"][0] == "ok"
    assert got["m2"][:2] == ("failed", "line 3 is malformed")
    assert got["m3"][0] == got["m7"][0] == "failed" and got["m3"][1] == got["m7"][1] == "header is not obs_name,y_true,y_pred,score"
    assert got["m4"][:2] == ("failed", "no rows") and got["m5"][:2] == ("skipped", "missing_reference")
    open(f"{root}/m1/late.csv", "w").write(good)
    assert run() == 1 and E.evaluations(spark, out).count() == 8
