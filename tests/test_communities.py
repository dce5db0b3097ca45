"""Distributed communities against a single-machine run, and their connectedness."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import plans
from lattica.operators import communities as L


def louvain(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, resolution: float = 1.0, seed: int = 0) -> np.ndarray:
    """Communities of a symmetric graph by Louvain moves and contraction; numbered by their first node."""
    rng = np.random.default_rng(seed)
    owner = np.arange(n)
    while True:
        size = int(owner.max()) + 1 if len(owner) else 0
        nbrs: list[dict[int, float]] = [{} for _ in range(size)]
        for a, b, x in zip(owner[src], owner[dst], w):
            nbrs[a][b] = nbrs[a].get(b, 0.0) + float(x)
        degree = np.array([sum(d.values()) for d in nbrs])
        total = degree.sum()
        if total == 0:
            break
        comm, strength, moved = np.arange(size), degree.copy(), False
        for _ in range(20):
            changed = 0
            for i in rng.permutation(size):
                gain: dict[int, float] = {}
                for j, x in nbrs[i].items():
                    if j != i:
                        gain[comm[j]] = gain.get(comm[j], 0.0) + x
                old = comm[i]
                strength[old] -= degree[i]
                best, top = old, gain.get(old, 0.0) - resolution * degree[i] * strength[old] / total
                for c in sorted(gain):
                    g = gain[c] - resolution * degree[i] * strength[c] / total
                    if g > top + 1e-12:
                        best, top = c, g
                strength[best] += degree[i]
                comm[i] = best
                changed += best != old
            moved |= changed > 0
            if not changed:
                break
        _, comm = np.unique(comm, return_inverse=True)
        owner = comm[owner]
        if not moved:
            break
    _, first = np.unique(owner, return_index=True)
    rank = np.empty(len(first), dtype=int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[owner]


def quality(edges, cluster):
    k, inside, m = defaultdict(float), 0.0, 0.0
    for a, b, w in edges:
        k[cluster[a]] += w
        inside += w * (cluster[a] == cluster[b])
        m += w
    return inside / m - sum((x / m) ** 2 for x in k.values())


def all_connected(edges, cluster):
    near = defaultdict(set)
    for a, b, _ in edges:
        if cluster[a] == cluster[b]:
            near[a].add(b)
    groups = defaultdict(set)
    for n, c in cluster.items():
        groups[c].add(n)
    for members in groups.values():
        seen, todo = set(), [next(iter(members))]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += near[n]
        if seen != members:
            return False
    return True


def single(edges):
    names, codes = np.unique([e[0] for e in edges] + [e[1] for e in edges], return_inverse=True)
    found = louvain(len(names), codes[: len(edges)], codes[len(edges) :], np.array([e[2] for e in edges]))
    return dict(zip(names.tolist(), found.tolist()))


def test_not_below_the_single_run(spark):
    sf = "/root/testdata/sf0.01"
    edges = plans.queries()["D16"](spark, sf).cache()
    got = defaultdict(dict)
    for r in plans.queries()["N10"](spark, sf).collect():
        got[r.slice_id][r.key] = r.cluster
    for slice_ in sorted(got):
        own = [(r.src, r.dst, r.w) for r in edges.where(F.col("slice_id") == slice_).collect()]
        mine, theirs = quality(own, got[slice_]), quality(own, single(own))
        print(slice_, round(mine, 4), round(theirs, 4), len(set(got[slice_].values())))
        assert mine >= theirs - 0.005
        assert all_connected(own, got[slice_])
        assert set(got[slice_]) == {e[0] for e in own}


def test_rings_of_cliques(spark):
    edges = []
    for g, n in (("a", 6), ("b", 4)):
        for c in range(n):
            edges += [(g, f"{c}-{i}", f"{c}-{j}", 1.0) for i in range(5) for j in range(5) if i != j]
            d = (c + 1) % n
            edges += [(g, f"{c}-0", f"{d}-1", 1.0), (g, f"{d}-1", f"{c}-0", 1.0)]
    df = spark.createDataFrame(edges, "g string, src string, dst string, w double")
    got = {(r.g, r.key): r.cluster for r in L.find_communities(df, "g").collect()}
    assert got == {(g, f"{c}-{i}"): str(c) for g, n in (("a", 6), ("b", 4)) for c in range(n) for i in range(5)}
    q = {r.g: r.q for r in L.modularity(df, spark.createDataFrame([(g, k, c) for (g, k), c in got.items()], "g string, node string, comm string"), "g").collect()}
    assert q["a"] == pytest.approx(quality([e[1:] for e in edges if e[0] == "a"], {k: c for (g, k), c in got.items() if g == "a"}))


def test_parts_and_empty_graphs(spark):
    path = [("g", f"{i:02d}", f"{j:02d}", 1.0) for i in range(30) for j in (i - 1, i + 1) if 0 <= j < 30 and {i, j} != {14, 15}]
    df = spark.createDataFrame(path, "g string, src string, dst string, w double")
    labels = spark.createDataFrame([("g", f"{i:02d}", "x") for i in range(30)], "g string, node string, comm string")
    got = {r.node: r.comm for r in L.connected_parts(df, labels, "g").collect()}
    assert got == {f"{i:02d}": "00" if i < 15 else "15" for i in range(30)}
    assert L.find_communities(df.limit(0), "g").count() == 0


def test_fallback(spark):
    assert [L.fallback_k(n) for n in (0, 7, 8, 18, 50, 199, 200, 10**6)] == [2, 2, 2, 3, 5, 9, 10, 10]
    df = spark.createDataFrame([(i, [float(i % 2 * 50 + i % 3), 1.0]) for i in range(8)], "k int, v array<double>")
    got = {r.k: r.cluster for r in L.kmeans_clusters(df, "k", "v").collect()}
    assert len(set(got.values())) == 2 and all(got[i] == got[i % 2] for i in range(8))
    assert L.kmeans_clusters(df.limit(1), "k", "v").count() == 1


def test_louvain_finds_cliques():
    edges = [(i, j) for c in range(3) for i in range(c * 5, c * 5 + 5) for j in range(c * 5, c * 5 + 5) if i != j] + [(0, 5), (5, 0), (5, 10), (10, 5)]
    src, dst = np.array(edges).T
    assert louvain(15, src, dst, np.ones(len(edges))).tolist() == [0] * 5 + [1] * 5 + [2] * 5
