"""Whitening against a dense eigendecomposition in numpy."""

import math

import numpy as np
import pytest

from lattica.llm import whitening as Wh

FIELDS = "vec_id long, embedding array<float>"


def brute(vectors: list, components: int):
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    dev = [int(sum((n * a - b) ** 2 for a, b in zip(row, s))) for row in x]
    z = ((n * x - s) / n).astype(float)
    values, vecs = np.linalg.eigh(z.T @ z / n)
    order = np.argsort(-values)[:components]
    return n, dev, values[order], z @ vecs[:, order] / np.sqrt(np.maximum(values[order], 1e-300)), values.sum()


def test_equals_dense(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((400, 50)) @ np.diag(1.2 ** -np.arange(50.0)) @ rng.standard_normal((50, 50)) * 3
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    odd = [(900, None), (901, [1.0, None] + [0.0] * 48), (902, [float("nan")] * 50), (903, [float("inf")] + [0.0] * 49), (904, [1.0, 2.0])]
    n, dev, values, z, trace = brute([v for _, v in rows], 32)
    df = spark.createDataFrame(rows + odd, FIELDS)
    got = Wh.whitened(df).collect()
    assert len(got) == 400 * 32 and {r.component for r in got} == set(range(1, 33))
    for r in got:
        assert r.n == n and r.deviation == dev[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        assert r.identity_error < 1e-9
    mine = np.zeros((400, 32))
    for r in got:
        mine[r.vec_id, r.component - 1] = r.whitened
    sign = np.sign((mine * z).sum(axis=0))
    assert np.abs(mine * sign - z).max() < 1e-7


def test_wide_vectors_stop_before_all_dimensions(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((300, 8)) @ rng.standard_normal((8, 120)) * 20 + rng.standard_normal((300, 120)) * 0.4
    rows = Wh.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(base)], FIELDS))
    model = Wh.fit(rows, 8)
    x = np.array([r.x for r in rows.collect()], dtype=float)
    want = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:8]
    assert np.allclose(model.values, want, rtol=1e-10)
    assert model.passes < 120 // 8


def test_breakdown_and_repeated_eigenvalues(spark):
    # a covariance with one eigenvalue many times over: every block after the first breaks down
    rows = [(2 * j + s, [float(8 * (1 - 2 * s)) if i == j else 0.0 for i in range(12)]) for j in range(12) for s in range(2)]
    got = Wh.whitened(spark.createDataFrame(rows, FIELDS), components=5)
    assert got.count() == 24 * 5
    assert got.first().identity_error < 1e-9
    model = Wh.fit(Wh.usable(spark.createDataFrame(rows, FIELDS)), 5)
    assert np.allclose(model.values, model.values[0])
    # dependent dimensions: as many components as there are independent ones
    flat = [(i, [float(i % 7), float(i % 7), float(i % 3), 4.0]) for i in range(50)]
    got = Wh.whitened(spark.createDataFrame(flat, FIELDS))
    assert {r.component for r in got.collect()} == {1, 2}


def test_odd_tables(spark):
    assert Wh.whitened(spark.createDataFrame([], FIELDS)).count() == 0
    assert Wh.whitened(spark.createDataFrame([(1, None)], FIELDS)).count() == 0
    assert Wh.whitened(spark.createDataFrame([(1, []), (2, [])], FIELDS)).count() == 0
    assert Wh.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, FIELDS)).count() == 0
    extra = spark.createDataFrame([(None, [1.0, 0.0], 1, 2.0), (None, [1.0, 0.0], 1, 2.0), (3, [0.0, 5.0], 1, 2.0)], f"{FIELDS}, x int, z double")
    got = Wh.whitened(extra)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert sorted(str(r.vec_id) for r in got.collect()) == ["3", "None", "None"]
    with pytest.raises(Exception, match="too large"):
        Wh.whitened(spark.createDataFrame([(1, [1e30]), (2, [0.0])], FIELDS))


def test_large_tables_keep_exact_deviations(spark):
    rows = spark.createDataFrame([([1_000_000 + 10**6, 1_000_000],)], "x array<long>")
    n = 10**9
    assert int(rows.select(Wh.deviation(n, [n * 1_000_000, n * 1_000_000])).first()[0]) == (n * 10**6) ** 2
