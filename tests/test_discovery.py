"""Discovery over trees, caches that notice changes, meta genes against numpy."""

import numpy as np
from pyspark.sql import functions as F

from lattica import plans
from lattica.operators import meta as G
from lattica.operators import paradigm as P
from lattica.sources import cache as C
from lattica.sources import discovery as D

SF = "/root/testdata/sf0.001"


def tree(spark, root, *paths):
    for p in paths:
        spark.range(1).coalesce(1).write.parquet(f"{root}/{p}")
    return D.listing(spark, str(root), "*.parquet")


def rel(df):
    return sorted("/".join(r.parts) for r in df.collect())


def test_precedence(spark, tmp_path):
    whole, one, two = "DLPFC/m/pool_40x/synthetic_pool_40x", "DLPFC/m/pool_40x/s1/synthetic", "DLPFC/m/pool_40x/slices/slice_s1"
    found = tree(spark, tmp_path / "a", whole, one, two, "Other/m/pool_40x/synthetic_pool_40x", "Other/m/pool_40x/s1/synthetic", "DLPFC/n/pool_40x/synthetic_pool_40x", "DLPFC/n/pool_40x/conditions/L/synthetic")
    got = D.selected(found, D.pool_rules(["DLPFC"]))
    assert rel(got) == sorted([one, two, "Other/m/pool_40x/synthetic_pool_40x", "DLPFC/n/pool_40x/synthetic_pool_40x"])
    assert len(rel(D.not_selected(found, got))) == 3
    assert rel(D.selected(found, D.slice_rules()).where("rule = 'folder'")) == [one, "Other/m/pool_40x/s1/synthetic"]
    assert rel(D.of(got, "DLPFC", ["n"])) == ["DLPFC/n/pool_40x/synthetic_pool_40x"]
    none = [D.Rule("nothing", F.lit(False), F.lit(""))]
    assert D.selected(found, none).count() == 0 and D.selected(found, none, all_if_none=True).count() == 7


def test_leaves(spark, tmp_path):
    found = tree(spark, tmp_path / "b", "a/synthetic", "a/inner/synthetic", "b/synthetic", "b/other", "synthetic")
    assert rel(D.leaves(found)) == ["a/inner/synthetic", "b/synthetic"]


def test_reference_paths(spark):
    rows = spark.createDataFrame([(p.split("/"),) for p in ("supervised_low_label/D/M/fraction10/seed1/x", "supervised_low_label/D/M/x", "cross_slice_generalization/D/M/x", "cross_slice_generalization/D/M/leave_s1/x", "spatial_cluster/D/M/x", "D/M/unsupervised/x", "D/M/x", "E/M/x")], "parts array<string>")
    got = [r[0] for r in rows.select(D.reference_path(["D"], ["M"])).collect()]
    low, cross = "supervised_low_label/D/model_inputs/M", "cross_slice_generalization/D/model_inputs/M"
    assert got == [f"{low}/fraction10/seed1", None, f"{cross}/fixed", f"{cross}/leave_s1", "spatial_cluster/D/model_inputs/M/unsupervised", "D/model_inputs/M/unsupervised", "D/model_inputs/M/supervised", None]


def test_cache_reads_what_it_kept_and_notices_a_change(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(i, f"s{i % 3}", [float(i), float(i * i % 7), 1.0]) for i in range(30)], "n int, slice_id string, vec array<double>")
    cache = C.Cache(spark, str(tmp_path), "set")
    one = cache.projected(df, df, "vec", 2)
    assert (cache.hits, cache.built) == (0, 2)
    fits = []
    monkeypatch.setattr(C.X, "pca", lambda *a: fits.append(a))
    again = cache.projected(df.repartition(5), df.orderBy(F.desc("n")), "vec", 2)
    assert cache.built == 2 and cache.hits == 1 and not fits
    assert "MapInArrow" not in again._jdf.queryExecution().toString() and again.inputFiles() == one.inputFiles()
    monkeypatch.undo()
    changed = df.withColumn("vec", F.when(F.col("n") == 3, F.array(F.lit(9.0), F.lit(9.0), F.lit(9.0))).otherwise(F.col("vec")))
    new = cache.projected(changed, changed, "vec", 2)
    assert cache.built == 4 and new.inputFiles() != one.inputFiles()
    assert spark.read.parquet("/".join(one.inputFiles()[0].split("/")[:-1])).count() == 0  # what is out of date is dropped
    assert cache.scoped("other").table("x", {}, {"df": df}, lambda: df).count() == 30
    folds = [cache.fold_projection(df, f, ["s0", "s1"][: f + 1], 2) for f in (0, 1, 0)]
    assert np.allclose(folds[0].components, folds[2].components) and not np.allclose(folds[0].mean, folds[1].mean)


def test_one_package_for_all_alphas(spark, tmp_path):
    real = spark.createDataFrame([(f"r{i}", "L") for i in range(8)], "obs_name string, label string")
    pool = spark.createDataFrame([(f"p{i}", "L") for i in range(20)], "obs_name string, label string")
    calls = []

    def builder(*a):
        calls.append(a)
        return P.builder("weighted_erm")(*a)

    cache = C.Cache(spark, str(tmp_path))
    got = cache.weighted_package(builder, real, pool, 1.0, [0.0, 0.25, 0.5], 1)
    assert len(calls) == 1
    for alpha, df in got.items():
        want = P.builder("weighted_erm")(real, pool, 1.0, alpha, 1)
        assert sorted((r.obs_name, round(r.loss_weight, 12)) for r in df.collect()) == sorted((r.obs_name, round(r.loss_weight, 12)) for r in want.collect())


def brute_meta(x, domains, target, start, rounds):
    inside, meta, name = domains == target, x[:, start].copy(), str(start)
    others, difference = len(x), 0.0
    for _ in range(rounds):
        kept = (meta > meta[inside].mean()) | inside
        t = inside[kept]
        if min(t.sum(), (~t).sum()) < 5:
            break
        z = []
        for col in x[kept].T:
            ranks = np.array([(col < v).sum() + ((col == v).sum() + 1) / 2 for v in col])
            a, b = t.sum(), (~t).sum()
            z.append((ranks[t].sum() - a * (a + b + 1) / 2) / np.sqrt(a * b * (a + b + 1) / 12))
        plus, minus = int(np.argmax(z)), int(np.argmin(z))
        new = meta + x[:, plus] - x[:, minus]
        new = new - new.min()
        gained = new[inside].mean() - new[~inside].mean()
        if (~t).sum() > others or gained < difference:
            break
        others, difference, meta, name = (~t).sum(), gained, new, f"{name}+{plus}-{minus}"
    return name, meta


def dense(df, spots, genes):
    x = np.zeros((len(spots), genes))
    at = {s: i for i, s in enumerate(spots)}
    for r in df.collect():
        x[at[r.spot], r.gene_idx] = r.value
    return x


def test_meta_gene_equals_numpy(spark):
    from lattica.plans.registry import expr

    e = expr(spark, SF)
    spots = sorted(r[0] for r in e.select("spot").distinct().collect())
    x, d = dense(e, spots, 60), np.array([f"D{s % 5}" for s in spots])
    for query, target, start, rounds in (("N16", "D1", 7, 5), ("N23", "D2", 11, 3)):
        name, meta = brute_meta(x, d, target, start, rounds)
        got = plans.queries()[query](spark, SF).collect()
        assert {r.spot: r.meta for r in got} == {s: round(float(m), 6) for s, m in zip(spots, meta)}
        if query == "N16":
            assert {r.name for r in got} == {name} and "+" in name


def test_meta_gene_of_planted_domain(spark):
    rng = np.random.default_rng(2)
    x = rng.poisson(2.0, (60, 8)).astype(float)
    x[:20, 3] += 6
    x[20:, 5] += 6
    rows = [(s, g, float(x[s, g])) for s in range(60) for g in range(8) if x[s, g]]
    domains = spark.createDataFrame([(s, "a" if s < 20 else "b") for s in range(60)], "spot int, domain string")
    found = G.find_meta_gene(spark.createDataFrame(rows, "spot int, gene_idx int, value double"), domains, "a", 0)
    assert found.name == brute_meta(x, np.array(["a"] * 20 + ["b"] * 40), "a", 0, 5)[0] and found.steps[0]["plus"] == 3 and found.steps[0]["minus"] == 5
    # a target that no spot has, and an empty table
    assert G.find_meta_gene(spark.createDataFrame(rows, "spot int, gene_idx int, value double"), domains, "none", 0).name == "0"
