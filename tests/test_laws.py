"""Count laws against brute force, tables of methods, slice pools and cluster results."""

import math

import numpy as np
import pytest

from lattica import plans
from lattica.operators import fits, methods, paradigm
from lattica.sources import loaders


def nb(y, mean, theta):
    return math.lgamma(y + theta) - math.lgamma(theta) - math.lgamma(y + 1) + theta * math.log(theta / (theta + mean)) + y * math.log(mean / (theta + mean))


def inflated(values, p0, log_p):
    """Log likelihood of values, one by one."""
    return sum(math.log(p0 + (1 - p0) * math.exp(log_p(0))) if y == 0 else math.log(1 - p0) + log_p(y) for y in values)


@pytest.fixture(scope="module")
def drawn():
    rng = np.random.default_rng(5)
    n = 300
    return {
        "even": rng.poisson(4, n),
        "wide": rng.poisson(rng.gamma(1.5, 3, n)),
        "holes": rng.poisson(5, n) * (rng.random(n) > 0.4),
        "both": rng.poisson(rng.gamma(2, 4, n)) * (rng.random(n) > 0.3),
        "none": np.zeros(n, dtype=int),
        "ones": (rng.random(n) > 0.5).astype(int),
    }


@pytest.fixture(scope="module")
def rows(spark, drawn):
    return spark.createDataFrame([(g, i, float(v)) for g, ys in drawn.items() for i, v in enumerate(ys)], "gene string, spot int, value double")


def test_counted_values_fit_like_single_ones(drawn):
    for ys in drawn.values():
        values, count = np.unique(ys, return_counts=True)
        one, many = fits.fit_counts(ys), fits.fit_counts(values, count)
        assert one.keys() == many.keys()
        for law in one:
            assert one[law]["loglik"] == pytest.approx(many[law]["loglik"], abs=1e-6)


def test_negative_binomial_is_the_best_of_a_grid(rows, drawn):
    for r in fits.fit_laws(rows, ["gene"], law="nb").collect():
        ys = drawn[r.gene]
        if r.gene == "none":
            continue
        assert r["mean"] == pytest.approx(ys.mean())
        assert r.loglik == pytest.approx(sum(nb(int(y), r["mean"], r.theta) for y in ys), abs=1e-4)
        assert r.loglik >= max(sum(nb(int(y), ys.mean(), t) for y in ys) for t in np.exp(np.linspace(-4, 9, 60))) - 1e-6


def test_zero_inflated_poisson_is_the_best_of_a_grid(rows, drawn):
    by_likelihood = {r.gene: r for r in fits.fit_laws(rows, ["gene"], law="zip").collect()}
    for r in fits.fit_zip(rows, ["gene"]).collect():
        ys = [int(y) for y in drawn[r.gene]]
        factorials = sum(math.lgamma(y + 1) for y in ys)
        if r.gene == "none":
            assert (r.law, r.rate, r.p0) == ("poisson", 0.0, 0.0)
            continue
        here = r.kernel - factorials
        assert here == pytest.approx(inflated(ys, r.p0, lambda y: y * math.log(r.rate) - r.rate - math.lgamma(y + 1)), abs=1e-6)
        assert here >= max(inflated(ys, p, lambda y: y * math.log(m) - m - math.lgamma(y + 1)) for m in np.linspace(0.3, 12, 60) for p in np.linspace(0, 0.8, 17)) - 1e-6
        other = by_likelihood[r.gene]
        assert (r.rate, r.p0) == (pytest.approx(other["mean"], abs=1e-3), pytest.approx(other["p0"], abs=1e-3))
        assert r.law == ("zip" if r.p0 > 0 else "poisson")
    # drawn with two fifths of the places emptied
    assert by_likelihood["holes"].p0 == pytest.approx(0.4, abs=0.06)


def test_zero_inflated_negative_binomial_is_not_bettered_nearby(rows, drawn):
    for r in fits.fit_laws(rows, ["gene"], law="zinb").where("gene in ('both', 'holes', 'wide')").collect():
        ys = [int(y) for y in drawn[r.gene]]
        assert r.loglik == pytest.approx(inflated(ys, r.p0, lambda y: nb(y, r["mean"], r.theta)), abs=1e-3)
        for m in (0.97, 1.03):
            for t in (0.9, 1.1):
                for p in (-0.02, 0.02):
                    assert r.loglik >= inflated(ys, min(max(r.p0 + p, 0), 0.99), lambda y: nb(y, r["mean"] * m, r.theta * t)) - 0.02


def test_domains_fit_alone_and_count_absent_rows_as_zeros(spark, rows, drawn):
    x = rows.where("gene in ('both', 'even')").selectExpr("gene", "spot % 2 as domain", "value").where("value > 0")
    sizes = spark.createDataFrame([(0, 150), (1, 150)], "domain int, n_spots long")
    lone = spark.createDataFrame([("rare", 0, 3.0)], "gene string, domain int, value double")
    found = {(r.domain, r.gene): r for r in fits.fit_domains(x.unionByName(lone), "domain", "gene", sizes).collect()}
    assert found[0, "rare"].law == "zero" and found[0, "rare"].p0 == 1.0 and len(found) == 5
    for (domain, gene), r in found.items():
        if gene != "rare":
            every = fits.fit_counts(drawn[gene][domain::2])
            law = fits.choose_law(every)
            assert r.law == law and r.loglik == pytest.approx(every[law]["loglik"], abs=1e-6) and r.n_nonzero == (drawn[gene][domain::2] > 0).sum()


def test_dropout_curve_is_the_best_of_a_grid(spark):
    rng = np.random.default_rng(2)
    values = {g: rng.poisson(m, 200) * (rng.random(200) > 1 / (1 + m)) for g, m in enumerate(np.exp(np.linspace(-1, 3, 25)))}
    rows = spark.createDataFrame([("a", g, float(v)) for g, ys in values.items() for v in ys], "part string, gene int, value double")
    r = fits.dropout_curves(rows, ["part"], "gene").first()
    x, zero = np.log([y.mean() for y in values.values()]), np.array([(y == 0).mean() for y in values.values()])
    loss = lambda x0, k: ((zero - 1 / (1 + np.exp(k * (x - x0)))) ** 2).sum()
    assert r.n_genes == 25
    assert loss(r.x0, r.k) <= min(loss(a, b) for a in np.linspace(-2, 3, 60) for b in np.linspace(0.2, 4, 60)) + 1e-6


def test_gains_over_a_baseline(spark):
    runs = spark.createDataFrame([("s1", "base", 0.5), ("s1", "base", 0.7), ("s2", "base", 0.4), ("s1", "new", 0.8), ("s2", "new", 0.7), ("s3", "lone", 0.1)], "slice string, method string, ari double")
    got = {r.method: r for r in methods.against(runs, "slice", "method", ["ari"], "base").collect()}
    assert (got["new"].ari_delta, got["new"].ari_delta_std) == (0.25, 0.0707)
    assert got["base"].ari_delta is None and got["lone"].ari_delta is None and got["lone"].ari_std is None


def test_cluster_tables_are_told_from_other_files(spark, tmp_path):
    for folder, name, text in (("m1/s=x", "spatial_clusters.csv", "obs_name,cluster\na,01\n"), ("m2/s=y", "spatial_clusters.csv", "obs_name,cluster\nb,2\n"), ("m1/s=x", "a_summary.csv", "other,columns,here\n1,2,3\n"), ("m1", "old_spatial_clusters.csv", "obs_name,cluster\nc,3\n")):
        (tmp_path / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    got = loaders.cluster_results(spark, str(tmp_path)).collect()
    assert sorted((r.obs_name, r.cluster, *r.parts) for r in got) == [("a", "01", "m1", "x"), ("b", "2", "m2", "y")]
    with pytest.raises(FileNotFoundError):
        loaders.cluster_results(spark, str(tmp_path), "nothing.csv")


def test_names_of_a_slice_pool(spark):
    drawn = spark.createDataFrame([("s 1", "L/2", "b"), ("s 1", "L/2", "a"), ("s 1", "new", "c")], "slice_id string, label string, at string")
    real = spark.createDataFrame([("s 1", "L/2")] * 3, "slice_id string, label string")
    got = paradigm.slice_pool(drawn, real, "splat", "t", 1, 0.5, "at").collect()
    assert sorted((r.obs_name, r.n_real_train_condition) for r in got) == [("syn_splat_s_1_L_2_0", 3), ("syn_splat_s_1_L_2_1", 3), ("syn_splat_s_1_new_0", 0)]


def test_likelihoods_at_given_parameters(drawn):
    for ys in drawn.values():
        y, count = np.unique(ys, return_counts=True)
        poisson = lambda v: v * math.log(3.5) - 3.5 - math.lgamma(v + 1)
        p0 = min(max((float((ys == 0).mean()) - math.exp(-3.5)) / (1 - math.exp(-3.5)), 1e-12), 1 - 1e-12)
        assert fits.zip_loglik(y, 3.5, count) == pytest.approx(inflated(map(int, ys), p0, poisson), abs=1e-6)
        assert fits.zip_loglik(ys, 3.5) == pytest.approx(fits.zip_loglik(y, 3.5, count), abs=1e-6)
        assert fits.zinb_loglik(y, 3.5, 1.7, -1.2, count) == pytest.approx(inflated(map(int, ys), 1 / (1 + math.exp(1.2)), lambda v: nb(v, 3.5, 1.7)), abs=1e-6)


def test_all_four_laws_of_a_gene_with_zeros_and_nulls(spark, drawn, tmp_path):
    import duckdb

    rows = [(i % 7, g, float(v)) for g, ys in enumerate(drawn.values()) for i, v in enumerate(ys)]
    rows += [(1, 2, None), (1, None, 0.0), (2, None, 4.0), (3, 11, None), (4, 12, 50.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    for name in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('/root/testdata/sf0.001/{name}.parquet')")
    laws = ["poisson", "nb", "zip", "zinb"]
    want = {r[0]: r[1:] for r in con.execute(f"SELECT gene, {', '.join(laws)} FROM ({plans.oracle_sql()['J23']})").fetchall()}
    got = {r.gene: tuple(r[c] for c in laws) for r in plans.queries()["J23"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    assert got[11] == want[11] == (None,) * 4
    for gene in set(got) - {11}:
        assert got[gene] == pytest.approx(want[gene], abs=0.011)
    ys = [int(y) for y in drawn["holes"]]
    assert got[2][2:] == pytest.approx((inflated(ys, sum(y == 0 for y in ys) / len(ys), lambda y: y * math.log(25) - 25 - math.lgamma(y + 1)), inflated(ys, 1 / (1 + math.exp(2)), lambda y: nb(y, 25, 4))), abs=0.011)
