"""Selections near real rows against a plain version, and count laws after a call on the driver."""

import math

import numpy as np

from lattica import plans
from lattica.operators import fits, spatial


def brute(real, pool, n):
    near = set()
    for x, y in real.values():
        near |= set(sorted(pool, key=lambda k: (round(math.hypot(pool[k][0] - x, pool[k][1] - y), 9), k))[:n])
    return sorted(near, key=lambda k: pool[k][2])[:n]


def frames(spark, real, pool):
    r = spark.createDataFrame([("g", k, [x, y]) for k, (x, y) in real.items()], "by string, key string, vec array<double>")
    p = spark.createDataFrame([("g", k, [x, y], at) for k, (x, y, at) in pool.items()], "by string, key string, vec array<double>, at long")
    return r, p


def test_nearest_selection_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    real = {f"r{i}": tuple(rng.integers(0, 6, 2).astype(float).tolist()) for i in range(12)}
    pool = {f"p{i}": (*rng.integers(0, 6, 2).astype(float).tolist(), int(at)) for i, at in enumerate(rng.permutation(30))}
    r, p = frames(spark, real, pool)
    for ratio, n in ((0.01, 1), (0.5, 6), (1.0, 12), (5.0, 30)):
        got = spatial.nearest_selection(r, p, spatial.wanted_by_ratio(r, "by", ratio), "by", "key", "vec", "at")
        assert sorted(x.key for x in got.collect()) == sorted(brute(real, pool, n))


def test_nearest_selection_in_tiles_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    real = {f"r{i}": tuple(rng.integers(0, 5, 2).astype(float).tolist()) for i in range(40)}
    pool = {f"p{i}": (*(rng.integers(0, 9, 2) * 1.0).tolist(), int(at)) for i, at in enumerate(rng.permutation(60))}
    r, p = frames(spark, real, pool)
    for n in (1, 5, 30, 60):
        want = spatial.wanted_by_ratio(r, "by", n / 40)
        got = spatial.nearest_selection(r, p, want, "by", "key", "vec", "at", tile=4)
        assert "_tile" in got._jdf.queryExecution().toString()
        assert sorted(x.key for x in got.collect()) == sorted(brute(real, pool, n))


def test_empty_sides_give_no_rows(spark):
    r, p = frames(spark, {"r": (0.0, 0.0)}, {"p": (0.0, 0.0, 1)})
    want = spatial.wanted_by_ratio(r, "by", 1.0)
    assert spatial.nearest_selection(r, p.limit(0), want, "by", "key", "vec", "at").count() == 0
    assert spatial.nearest_selection(r.limit(0), p, want.limit(0), "by", "key", "vec", "at").count() == 0


def test_ratios_by_density(spark):
    rows = [(g, i) for g, c in (("a", 5), ("b", 9), ("c", 2), ("d", 5)) for i in range(c)]
    got = spatial.wanted_by_density(spark.createDataFrame(rows, "by string, i long"), "by", 4)
    assert {r.by: r.n for r in got.collect()} == {"b": 9, "a": 10, "d": 15, "c": 8}
    one = spatial.wanted_by_density(spark.createDataFrame([("a", 1)], "by string, i long"), "by", 4)
    assert [r.n for r in one.collect()] == [4]


def test_log_gamma():
    x = np.concatenate([np.geomspace(1e-4, 1e7, 500), np.arange(1.0, 40.0)])
    want = np.array([math.lgamma(v) for v in x])
    assert np.all(np.abs(fits._lgamma(x) - want) <= 1e-11 * np.maximum(1, np.abs(want)))


def test_count_laws_run_on_executors_after_a_call_on_the_driver(spark):
    fits.fit_counts(np.array([0, 1, 2, 5, 0, 3]))
    for name in ("J23", "O4", "E32"):
        assert plans.queries()[name](spark, "/root/testdata/sf0.001").limit(5).collect()


def test_poisson_likelihood_takes_a_row_for_each_value(spark, monkeypatch):
    from pyspark.sql.group import GroupedData

    seen = []
    monkeypatch.setattr(GroupedData, "applyInPandas", lambda self, f, schema: seen.append(self._df) or self._df)
    plans.queries()["J23"](spark, "/root/testdata/sf0.001")
    rows = seen[0].collect()
    assert len({(r["gene"], r["value"]) for r in rows}) == len(rows) and sum(r["n"] for r in rows) > len(rows)
