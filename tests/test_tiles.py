"""Sums over pairs in tiles, and the searches on them, against numpy over all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lattica.operators import spatial as N
from lattica.operators import tiles as T

rng = np.random.default_rng(1)
POINTS = pd.DataFrame({"slice_id": ["a"] * 90 + ["b"] * 41 + ["c"], "obs_name": [f"o{i}" for i in range(132)], "x": rng.normal(0, 2, 132), "y": rng.normal(0, 1, 132), "label": [f"L{i % 4}" for i in range(132)]})


def distances(name):
    p = POINTS[POINTS.slice_id == name][["x", "y"]].to_numpy()
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))


def test_sums_in_small_tiles(spark):
    df = spark.createDataFrame(POINTS)
    got = {(r.slice_id, r.l): r.p for r in T.adjacency_scales(df, "slice_id", "obs_name", [0.2, 1.5], 16).collect()}
    for s in "abc":
        for l in (0.2, 1.5):
            assert got[s, l] == pytest.approx(np.exp(-distances(s) ** 2 / (2 * l * l)).sum(axis=1).mean() - 1, abs=1e-12)
    sums = {r.obs_name: r.d for r in T.distance_sums(df, "slice_id", "obs_name", 16).collect()}
    want = np.concatenate([distances(s).sum(axis=1) for s in "abc"])
    assert [sums[f"o{i}"] for i in range(132)] == pytest.approx(want.tolist())
    edges = np.array([0.5, 1.0, 2.0])
    hist = {(r.slice_id, r.bin): r.n for r in T.distance_histogram(df, "slice_id", "obs_name", edges, 16).collect()}
    assert {k: v for k, v in hist.items() if k[0] == "a"} == {("a", int(b)): int(n) for b, n in zip(*np.unique(np.searchsorted(edges, distances("a").ravel()), return_counts=True))}


def test_length_search(spark):
    got = {r.slice_id: r.l for r in T.search_length(spark.createDataFrame(POINTS), "slice_id", "obs_name", 3.0, size=32).collect()}
    for s in "ab":
        d2 = distances(s) ** 2
        l = T._crossing(lambda t: np.exp(-d2 / (2 * t * t)).sum(axis=1).mean() - 1, 3.0, 0.001, 100.0)  # noqa: B023
        assert got[s] == pytest.approx(l, abs=1e-4)
    assert got["c"] == 100.0  # one point alone never gets there


def bisected(d, inside, start, end, least, most):
    n = lambda r: (d[inside] ** 2 <= r * r).sum() / inside.sum()
    for r in (start, end):
        if least <= n(r) <= most:
            return r
    if n(start) > most or n(end) < least:
        return None
    for _ in range(100):
        mid = (start + end) / 2
        if least <= n(mid) <= most:
            return mid
        start, end = (mid, end) if n(mid) < least else (start, mid)
    return None


@pytest.mark.parametrize("least,most", [(8, 15), (20, 20.4), (1, 1), (60, 70), (5.01, 5.02)])
def test_radius_search(spark, least, most):
    got = {r.slice_id: r.radius for r in T.search_radius(spark.createDataFrame(POINTS), "slice_id", "obs_name", "label", "L1", 0.01, 3.0, least, most, levels=3, size=32).collect()}
    for s in "ab":
        inside = (POINTS[POINTS.slice_id == s].label == "L1").to_numpy()
        assert got[s] == bisected(distances(s), inside, 0.01, 3.0, least, most)


def test_resolution_search():
    seen = []
    found = T.search_resolution(lambda r: seen.append(r) or round(r * 10), 7)
    assert found == pytest.approx(0.7) and len(seen) == 4
    assert T.search_resolution(lambda r: 3 if r < 0.55 else 9, 5) == pytest.approx(0.55, abs=0.01)


def test_neighbours_in_small_tiles(spark):
    df = spark.createDataFrame(POINTS.assign(vec=[[a, b] for a, b in zip(POINTS.x, POINTS.y)]))
    got = N.knn_join(df, df, "slice_id", "obs_name", "vec", 4, "euclidean", exclude_self=True, tile=16).toPandas().sort_values(["obs_name", "rank"])
    whole = N.knn_join(df, df, "slice_id", "obs_name", "vec", 4, "euclidean", exclude_self=True).toPandas().sort_values(["obs_name", "rank"])
    assert got.reset_index(drop=True).equals(whole.reset_index(drop=True)) and len(got) == 131 * 4
    d = distances("a")
    np.fill_diagonal(d, np.inf)
    near = got[got.obs_name == "o3"].neighbour.tolist()
    assert near == [f"o{j}" for j in np.argsort(d[3])[:4]]


def test_large_groups_have_larger_tiles_not_more(spark):
    df = spark.range(40_000).select(F.lit("g").alias("g"), "id")
    assert T.with_tiles(df, "g", "id", 64).select("_tile", "_tiles").distinct().count() == T.MANY
    assert T.with_tiles(df.limit(100), "g", "id", 64).first()["_tiles"] == 2


def test_a_pair_of_tiles_holds_a_strip_of_distances():
    rng = np.random.default_rng(2)
    one, two = (pd.DataFrame({"x": rng.normal(0, 1, n), "y": rng.normal(0, 1, n)}) for n in (900, 3000))
    seen, out = 0, []
    for rows, d2 in T._squares(one, two):
        seen = max(seen, d2.size)
        assert rows.start == len(out)
        out.extend(d2.copy())
    assert seen <= T._STRIP and np.array(out) == pytest.approx((one.x.to_numpy()[:, None] - two.x.to_numpy()) ** 2 + (one.y.to_numpy()[:, None] - two.y.to_numpy()) ** 2)


def test_pairs_of_a_group_are_dealt_by_tiles(spark):
    df = spark.createDataFrame(POINTS)
    got = {(r.src, r.dst): r.d for r in N.pairwise(df, "slice_id", "obs_name", 16).collect()}
    assert len(got) == 90 * 90 + 41 * 41 + 1
    d = distances("a")
    assert all(got[f"o{i}", f"o{j}"] == pytest.approx(d[i, j], abs=1e-12) for i in range(90) for j in range(0, 90, 7))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = N.pairwise(df.where("slice_id = 'a'"), "slice_id", "obs_name", 16).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts > 1


def test_tasks_of_pairs_are_as_many_as_the_pairs_need(spark):
    df = spark.createDataFrame(POINTS)
    sizes = [r["count"] for r in N.pairwise(df, "slice_id", "obs_name", 16).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 90 * 90 + 41 * 41 + 1 and len(sizes) > 8 and max(sizes) < sum(sizes) / 4
    assert T.pair_tasks(df, "slice_id", 16) == 39  # 9,782 pairs of 256 a task
    assert T.pair_tasks(df, "slice_id", 2) == 4 * (16 * 16 + 16 * 16 + 1)  # groups a and b have 16 tiles, however small
    none = spark.createDataFrame([(None, "o", 0.0, 0.0)], "slice_id string, obs_name string, x double, y double")
    assert N.pairwise(none, "slice_id", "obs_name").count() == 0
