"""Queries for fits, projections, models, simulators, sources and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import communities as L
from ..operators import features as X
from ..operators import fits as P
from ..operators import metrics as M
from ..operators import sampling as A
from ..operators import simulate as O
from ..sources import bundle as B
from ..streaming import monitor
from .metric_queries import _CLS, _PER
from .registry import expr, predictions, query, real, spots, table


def _li(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("region"), (F.col("l_partkey") % 20).alias("gene"), F.col("l_quantity").cast("double").alias("value"))


_LI = "li AS (SELECT l_suppkey % 10 AS region, l_partkey % 20 AS gene, l_quantity::DOUBLE AS value FROM lineitem)"


@query("E22", "SELECT spot, library, round(library / quantile_cont(library, 0.5) OVER (), 6) AS size_factor FROM (SELECT spot, sum(value) AS library FROM expr GROUP BY spot)")
def e22(spark, sf):
    return P.size_factors(expr(spark, sf).withColumn("g", F.lit(1)), ["g"]).select("spot", "library", F.round("size_factor", 6).alias("size_factor"))


@query("E23", "SELECT g, round(avg(ln(l)), 6) AS mean, round(stddev_samp(ln(l)), 6) AS sd FROM (SELECT spot % 8 AS g, spot, greatest(sum(value), 1) AS l FROM expr GROUP BY ALL) GROUP BY g")
def e23(spark, sf):
    lib = P.size_factors(expr(spark, sf).withColumn("g", F.col("spot") % 8), ["g"])
    return P.log_library(lib, ["g"]).select("g", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"))


_R6 = lambda *c: [F.round(x, 6).alias(x) for x in c]


@query("E24", f", {_LI} SELECT region, gene, count(*) AS n, round(avg(value), 6) AS mean, round(pow(avg(value), 2) / var_samp(value), 6) AS shape, round(var_samp(value) / avg(value), 6) AS scale, round(avg((value = 0)::INT), 6) AS zero_rate FROM li GROUP BY ALL")
def e24(spark, sf):
    return P.gamma_moments(_li(spark, sf), ["region", "gene"]).select("region", "gene", "n", *_R6("mean", "shape", "scale", "zero_rate"))


_NB = "round(avg(value), 6) AS mean, round(CASE WHEN var_samp(value) > avg(value) THEN least(greatest(pow(avg(value), 2) / (var_samp(value) - avg(value)), 1e-3), 1e6) ELSE 1e6 END, 6) AS theta"


@query("E25", f", {_LI} SELECT region, gene, {_NB}, round(avg((value = 0)::INT), 6) AS zero_rate FROM li GROUP BY ALL")
def e25(spark, sf):
    return P.negative_binomial_moments(_li(spark, sf), ["region", "gene"]).select("region", "gene", *_R6("mean", "theta", "zero_rate"))


@query("E26", f", f AS (SELECT spot, sum(value) AS l FROM expr GROUP BY spot), n AS (SELECT gene_idx, value / (l / (SELECT quantile_cont(l, 0.5) FROM f)) AS value FROM expr JOIN f USING (spot)) SELECT gene_idx, {_NB} FROM n GROUP BY gene_idx")
def e26(spark, sf):
    e = expr(spark, sf).withColumn("g", F.lit(1))
    normal = e.join(P.size_factors(e, ["g"]).select("spot", "size_factor"), "spot").withColumn("value", F.col("value") / F.col("size_factor"))
    return P.negative_binomial_moments(normal, ["gene_idx"]).select("gene_idx", *_R6("mean", "theta"))


@query("E28", f", {_LI} SELECT region, round(1.4826 * quantile_cont(abs(value - m), 0.5), 6) AS mad FROM (SELECT region, value, quantile_cont(value, 0.5) OVER (PARTITION BY region) AS m FROM li) GROUP BY region")
def e28(spark, sf):
    return P.mad(_li(spark, sf), ["region"], "value").select("region", F.round("mad", 6).alias("mad"))


@query("E29", f", {_LI} SELECT region, round(avg(least(greatest(value, a), b)), 6) AS mean FROM (SELECT region, value, quantile_cont(value, 0.1) OVER (PARTITION BY region) AS a, quantile_cont(value, 0.9) OVER (PARTITION BY region) AS b FROM li) GROUP BY region")
def e29(spark, sf):
    return P.winsorised(_li(spark, sf), ["region"], "value", 0.1).groupBy("region").agg(F.round(F.avg("value"), 6).alias("mean"))


@query("E30", f", {_LI} SELECT region, round(quantile_cont((v - m) / (m * m), 0.5), 6) AS dispersion FROM (SELECT region, gene, avg(value) AS m, var_samp(value) AS v FROM li GROUP BY ALL) WHERE m > 0 AND v > m GROUP BY region")
def e30(spark, sf):
    return P.common_dispersion(_li(spark, sf), ["region"], "gene").select("region", F.round("dispersion", 6).alias("dispersion"))


@query("E31", f", {_LI} SELECT region, round(pow(avg(value), 2) / var_samp(value), 6) AS shape, round(avg(ln(value)), 6) AS log_mean, round(stddev_samp(ln(value)), 6) AS log_sd FROM li GROUP BY region")
def e31(spark, sf):
    li = _li(spark, sf)
    g = P.gamma_moments(li, ["region"]).select("region", F.round("shape", 6).alias("shape"))
    return g.join(P.log_library(li.withColumnRenamed("value", "library"), ["region"]).select("region", F.round("mean", 6).alias("log_mean"), F.round("sd", 6).alias("log_sd")), "region")


@query("E32a", f", {_LI} SELECT gene, round(avg(value), 6) AS rate, round(sum(value * ln(m) - m), 3) AS kernel FROM (SELECT gene, value, avg(value) OVER (PARTITION BY gene) AS m FROM li) GROUP BY gene")
def e32a(spark, sf):
    m = F.avg("value").over(W.partitionBy("gene"))
    return _li(spark, sf).withColumn("m", m).groupBy("gene").agg(F.round(F.avg("value"), 6).alias("rate"), F.round(F.sum(F.col("value") * F.log("m") - F.col("m")), 3).alias("kernel"))


@query("E32")
def e32(spark, sf):
    small = _li(spark, sf).withColumn("value", F.floor(F.col("value") / 10) * (F.col("value") % 3 > 0).cast("int"))
    return P.fit_laws(small.withColumn("value", F.col("value").cast("double")), ["region", "gene"]).select("region", "gene", "law", *[F.round(c, 4).alias(c) for c in ("mean", "theta", "p0", "loglik")])


@query("E32e", f", {_LI} SELECT gene, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM li GROUP BY gene")
def e32e(spark, sf):
    return _li(spark, sf).groupBy("gene").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("E36", f""", {_LI}, c AS (SELECT gene, value, count(*) FILTER (region = 1) AS a, count(*) FILTER (region <> 1) AS b FROM li GROUP BY ALL),
r AS (SELECT *, coalesce(sum(a + b) OVER (PARTITION BY gene ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (a + b + 1) / 2 AS rank FROM c),
s AS (SELECT gene, sum(a)::DOUBLE AS na, sum(b)::DOUBLE AS nb, sum(a * rank) AS w, sum(pow(a + b, 3) - (a + b)) AS t, sum(a) FILTER (value > 0) AS pa, sum(b) FILTER (value > 0) AS pb, sum(a * value) AS sa, sum(b * value) AS sb FROM r GROUP BY gene)
SELECT gene, round(pa / na, 6) AS in_fraction, round(pb / nb, 6) AS out_fraction, round(ln((sa / na + 1e-9) / (sb / nb + 1e-9)), 6) AS log_fold, round((w - na * (na + nb + 1) / 2) / sqrt(na * nb / 12 * ((na + nb + 1) - t / ((na + nb) * (na + nb - 1)))), 6) AS z FROM s""")
def e36(spark, sf):
    return P.rank_sums(_li(spark, sf).withColumn("inside", F.col("region") == 1), "gene", "inside")


@query("E36_p")
def e36_p(spark, sf):
    return P.with_p_values(e36(spark, sf))


@query("E37", f", {_LI} SELECT gene, region, round((m - min(m) OVER w) / (max(m) OVER w - min(m) OVER w), 6) AS v FROM (SELECT gene, region, avg(value) AS m FROM li GROUP BY ALL) WINDOW w AS (PARTITION BY gene)")
def e37(spark, sf):
    w = W.partitionBy("gene")
    m = _li(spark, sf).groupBy("gene", "region").agg(F.avg("value").alias("m"))
    return m.select("gene", "region", F.round((F.col("m") - F.min("m").over(w)) / (F.max("m").over(w) - F.min("m").over(w)), 6).alias("v"))


_QUANT = ", ".join(f"quantile_cont(vec[{i + 1}], {q})" for q in (0.1, 0.5, 0.9) for i in range(64))
_MEANS = ", ".join(f"sum(w * vec[{i + 1}]) / sum(w)" for i in range(64))
_STDS = ", ".join(f"sqrt(greatest(sum(w * vec[{i + 1}] * vec[{i + 1}]) / sum(w) - pow(sum(w * vec[{i + 1}]) / sum(w), 2), 0))" for i in range(64))


_E21 = f"SELECT slice_id, list_transform([{_MEANS}, {_STDS}, {_QUANT}, avg(x), avg(y), stddev_pop(x), stddev_pop(y), max(x) - min(x), max(y) - min(y)], lambda v: round(v, 6)) AS features FROM (SELECT *, 1 + pos % 3 AS w FROM spots) GROUP BY slice_id"


@query("E21", _E21)
def e21(spark, sf):
    return X.sample_vector(spots(spark, sf), ["slice_id"], "vec", 64, 1 + F.col("pos") % 3)


@query("J15", "SELECT spot, gene_idx, round(ln(1 + value * 1e4 / t), 6) AS v FROM (SELECT *, sum(value) OVER (PARTITION BY spot) AS t FROM expr)")
def j15(spark, sf):
    e = expr(spark, sf)
    v = S.log_normalised(F.col("value"), F.sum("value").over(W.partitionBy("spot")))
    return e.select("spot", "gene_idx", F.round(S.scrubbed(v), 6).alias("v"))


_CAL = """g AS (SELECT spot, gene_idx, value * 1.5 AS value FROM expr WHERE spot % 2 = 1), t AS (SELECT * FROM expr WHERE spot % 2 = 0), cap AS (SELECT gene_idx, quantile_cont(value, 0.9) AS cap FROM t GROUP BY gene_idx), top AS (SELECT quantile_cont(l, 0.9) AS top FROM (SELECT sum(value) AS l FROM t GROUP BY spot)),
c AS (SELECT spot, gene_idx, least(greatest(value, 0), cap) AS value FROM g JOIN cap USING (gene_idx)), l AS (SELECT *, sum(value) OVER (PARTITION BY spot) AS l FROM c)"""


@query("J19", f", {_CAL} SELECT spot, gene_idx, round(CASE WHEN l > top THEN value * top / l ELSE value END, 6) AS value FROM l, top")
def j19(spark, sf):
    e = expr(spark, sf)
    out = P.calibrated(e.where("spot % 2 = 1").withColumn("value", F.col("value") * 1.5), e.where("spot % 2 = 0"), "gene_idx", "spot", 0.9, 0.9)
    return out.select("spot", "gene_idx", F.round("value", 6).alias("value"))


@query("J20", "SELECT spot, gene_idx, round(value * 5000 / (sum(value) OVER (PARTITION BY spot) + 1e-8), 6) AS value FROM expr")
def j20(spark, sf):
    return P.library_scaled(expr(spark, sf), "spot", 5000.0).select("spot", "gene_idx", F.round("value", 6).alias("value"))


#: Log likelihoods at given parameters: mean 25, theta 4, logit of the zeros of the last law -2.
@query("J23", f""", {_LI},
t AS (SELECT gene, value, value * ln(25) - 25 - lgamma(value + 1) AS p, lgamma(value + 4) - lgamma(4) - lgamma(value + 1) + 4 * ln(4) + value * ln(25) - (value + 4) * ln(29) AS b FROM li),
a AS (SELECT gene, nullif(count(value), 0)::DOUBLE AS n, count(*) FILTER (value = 0)::DOUBLE AS zeros, sum(p) AS p, sum(b) AS b, coalesce(sum(p) FILTER (value <> 0), 0) AS pp, coalesce(sum(b) FILTER (value <> 0), 0) AS bp FROM t GROUP BY gene),
z AS (SELECT *, least(greatest((zeros / n - exp(-25)) / (1 - exp(-25)), 1e-12), 1 - 1e-12) AS p0, 1 / (1 + exp(2)) AS p1 FROM a)
SELECT gene, round(p, 2) AS poisson, round(b, 2) AS nb, round(zeros * ln(p0 + (1 - p0) * exp(-25)) + (n - zeros) * ln(1 - p0) + pp, 2) AS zip, round(zeros * ln(p1 + (1 - p1) * pow(4 / 29, 4)) + (n - zeros) * ln(1 - p1) + bp, 2) AS zinb FROM z""")
def j23(spark, sf):
    import pandas as pd

    def run(pdf):
        seen = pdf[pdf["n"] > 0]
        y, n = seen["value"].to_numpy(), seen["n"].to_numpy()
        laws = {"poisson": P.poisson_loglik(y, 25.0, n), "nb": P.nb_loglik(y, 25.0, 4.0, n), "zip": P.zip_loglik(y, 25.0, n), "zinb": P.zinb_loglik(y, 25.0, 4.0, -2.0, n)}
        return pd.DataFrame({"gene": pdf["gene"].iloc[:1], **{law: [round(v, 2) if len(seen) else None] for law, v in laws.items()}})

    # a batch holds the distinct values of a gene; null ones are counted 0 times
    counts = _li(spark, sf).groupBy("gene", "value").agg(F.count("value").alias("n"))
    return counts.groupBy("gene").applyInPandas(run, "gene long, poisson double, nb double, zip double, zinb double")


@query("J28", """, part AS (SELECT obs_name, slice_id, ('0x' || substr(md5('42||' || obs_name), 1, 8))::BIGINT AS a, ('0x' || substr(md5('42||' || obs_name), 9, 8))::BIGINT AS b, ('0x' || substr(md5('42||' || obs_name), 17, 8))::BIGINT AS c FROM pool),
ref AS (SELECT slice_id, x, y, row_number() OVER (PARTITION BY slice_id ORDER BY obs_name) - 1 AS place, count(*) OVER s AS m, stddev_pop(x) OVER s AS sx, stddev_pop(y) OVER s AS sy FROM real WINDOW s AS (PARTITION BY slice_id)),
drawn AS (SELECT obs_name, ref.*, sqrt(-2 * ln((b + 1) / 4294967297)) AS r, 2 * pi() * c / 4294967296 AS t FROM part JOIN ref ON part.slice_id = ref.slice_id AND a % m = place)
SELECT obs_name, round(x + greatest(sx * 0.08, 1e-6) * r * cos(t), 6) AS x, round(y + greatest(sy * 0.08, 1e-6) * r * sin(t), 6) AS y FROM drawn""")
def j28(spark, sf):
    rows = spots(spark, sf).where("source = 'synthetic'").select("obs_name", "slice_id", "x", "y")
    out = O.jittered(rows, real(spark, sf), ["slice_id"], "obs_name", 0.08, 42)
    return out.select("obs_name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("J29")
def j29(spark, sf):
    parts = X.mixture(real(spark, sf), 3)
    return spark.createDataFrame([(k, round(float(w), 4), round(float(m[0]), 4), round(float(m[1]), 4)) for k, (w, m, _) in enumerate(parts)], "component int, weight double, x double, y double")


@query("N1")
def n1(spark, sf):
    out = X.pca(real(spark, sf), "vec", 10).transform(spots(spark, sf), "vec")
    return out.select("obs_name", F.transform("features", lambda v: F.round(v, 5)).alias("features"))


@query("N1_variance", "SELECT round(sum(var_pop(vec[k])) OVER (), 5) AS total FROM real, (SELECT unnest(range(1, 65)) AS k) GROUP BY k LIMIT 1")
def n1_variance(spark, sf):
    """The components' variances add up to the total variance."""
    p = X.pca(real(spark, sf), "vec", 64)
    return spark.createDataFrame([(round(float(p.variance.sum()), 5),)], "total double")


@query("N2")
def n2(spark, sf):
    out = X.pca(real(spark, sf), "vec", 10, centred=False).transform(spots(spark, sf), "vec")
    return out.select("obs_name", F.transform("features", lambda v: F.round(v, 5)).alias("features"))


def _split(spark, sf):
    s = A.stratified_split(spots(spark, sf).where("label is not null"), ["label"], 0.6, 42, "obs_name").withColumn("w", 1.0 + F.col("pos") % 3)
    return s.where("split = 'train'"), s.where("split = 'test'")


def _classified(name):
    def f(spark, sf):
        train, test = _split(spark, sf)
        train, test = X.scaled(train, test, "vec", 64)
        m = X.train_classifier(train, "vec", "label", name, None if name == "mlp" else "w")
        return X.predict(m, test, "vec", 1).select("obs_name", "label", "y_pred", F.round("score", 3).alias("score"))

    return f


for _id, _name in (("N4", "lr"), ("N5", "gbt"), ("N5_forest", "forest"), ("N6", "mlp")):
    query(_id)(_classified(_name))


@query("N7")
def n7(spark, sf):
    return _classified("lr")(spark, sf)


@query("N8")
def n8(spark, sf):
    return _classified("lr")(spark, sf).select("obs_name", "score")


#: The training matrix of the fold that holds out slice s0: the vectors of the other samples.
@query("N9", f"SELECT slice_id, features FROM ({_E21}) WHERE slice_id <> 's0'")
def n9(spark, sf):
    return X.sample_vector(spots(spark, sf).where("slice_id != 's0'"), ["slice_id"], "vec", 64, 1 + F.col("pos") % 3)


@query("N10")
def n10(spark, sf):
    from .spatial_queries import d16

    return L.find_communities(d16(spark, sf), "slice_id")


@query("N10_fallback", "SELECT count(DISTINCT cluster) AS clusters, count(*) AS n FROM (SELECT obs_name, least(greatest(floor(sqrt(count(*) OVER () / 2)), 2), 10)::INT AS k, row_number() OVER () AS r FROM real) t, LATERAL (SELECT (r % k) AS cluster)")
def n10_fallback(spark, sf):
    """As many clusters as the rule says, and every row in one."""
    return L.kmeans_clusters(real(spark, sf), "obs_name", "vec").agg(F.count_distinct("cluster").alias("clusters"), F.count("*").alias("n"))


@query("N12")
def n12(spark, sf):
    return X.spatial_regions(real(spark, sf), 6, 5).select("obs_name", "region")


@query("E12")
def e12(spark, sf):
    s = spots(spark, sf).withColumn("cluster", F.concat(F.lit("c"), F.col("pos") % 7))
    return X.mapped_metrics(s, ["slice_id"], "label", "cluster")


def _counts(spark, sf):
    return table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 2).alias("label"), (F.col("l_orderkey") % 40).alias("spot"), (F.col("l_partkey") % 30).alias("gene")).agg(F.count("*").cast("double").alias("value"))


for _id, _name in (("O1", "gamma_hypergeometric"), ("O3", "gamma_poisson"), ("O4", "marginal_ranks"), ("O6", "negative_binomial")):
    query(_id)(lambda spark, sf, name=_name: O.simulated(_counts(spark, sf), ["label"], "spot", "gene", "value", name, 2.0))


@query("O11", "SELECT label, 3 * count(DISTINCT spot) AS n FROM (SELECT l_suppkey % 2 AS label, l_orderkey % 40 AS spot FROM lineitem) GROUP BY label")
def o11(spark, sf):
    pool = O.simulated(_counts(spark, sf), ["label"], "spot", "gene", "value", "gamma_poisson", 3.0)
    return pool.groupBy("label").agg(F.countDistinct("synthetic_id").alias("n"))


@query("O10", "SELECT obs_name, list_transform(vec, lambda v: round(sqrt(0.36) * v + sqrt(0.64) * 0.5, 6)) AS vec FROM spots")
def o10(spark, sf):
    s = spots(spark, sf).select("obs_name", "vec").withColumn("noise", F.array_repeat(F.lit(0.5), F.size("vec")))
    return O.noised(s, "vec", "noise", 0.36).select("obs_name", F.transform("vec", lambda v: F.round(v, 6)).alias("vec"))


@query("O21")
def o21(spark, sf):
    rows = [(k, *(round(v, 9) for v in r)) for k, r in enumerate(O.posterior(S.cosine_betas(50)))]
    return spark.createDataFrame(rows, "step int, variance double, c_x0 double, c_xt double")


@query("O20", "SELECT t::INT AS step, [round(cos(t), 6), round(cos(t * exp(-ln(10000) / 2)), 6), round(sin(t), 6), round(sin(t * exp(-ln(10000) / 2)), 6)]::DOUBLE[] AS embedding FROM range(20) r(t)")
def o20(spark, sf):
    return spark.createDataFrame([(t, [round(v, 6) for v in O.timestep_embedding(t, 4)]) for t in range(20)], "step int, embedding array<double>")


# Sources and sinks


@query("A1", "SELECT obs_name, pos, slice_id, label, x, y, source FROM spots")
def a1(spark, sf):
    path = B.scratch(spark, "bundle")
    B.write_bundle({"spots": spots(spark, sf).drop("vec")}, path, {"spots": "slice_id"})
    return B.read_bundle(spark, path, "spots")["spots"]


@query("A3", "SELECT 'q' || k AS sample, n_name AS gene, v AS value FROM (SELECT n_name, unnest([1, 2]) AS k, unnest([n_nationkey * 1.5, n_regionkey * 2.0]::DOUBLE[]) AS v FROM nation)")
def a3(spark, sf):
    wide = table(spark, sf, "nation").select("n_name", (F.col("n_nationkey") * 1.5).cast("double").alias("q1"), (F.col("n_regionkey") * 2.0).cast("double").alias("q2"))
    return B.samples_to_rows(wide, "n_name", ["q1", "q2"])


@query("A4", "SELECT c_custkey, coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM customer LEFT JOIN (SELECT o_custkey AS c_custkey, avg(o_orderkey % 100) AS x, avg(o_orderkey % 7) AS y FROM orders GROUP BY 1) USING (c_custkey)")
def a4(spark, sf):
    patches = table(spark, sf, "orders").select(B.image_key(F.concat(F.col("o_custkey").cast("string"), F.lit(".SVS"))).cast("long").alias("c_custkey"), (F.col("o_orderkey") % 100).alias("x"), (F.col("o_orderkey") % 7).alias("y"))
    return B.mean_coordinates(table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey")), patches, "c_custkey")


@query("A5", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id ELSE event_id END AS v FROM events")
def a5(spark, sf):
    m = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("positions"), "user_id")).otherwise(F.create_map(F.lit("coords"), "event_id"))
    return table(spark, sf, "events").select("event_id", m.alias("m")).select("event_id", F.coalesce(F.try_element_at("m", F.lit("positions")), F.try_element_at("m", F.lit("coords"))).alias("v"))


def _scanned(spark, sf):
    """Prediction files by model, each folder with a manifest beside them, read back together."""
    path = B.scratch(spark, "predictions")
    p = predictions(spark, sf).select("obs_name", "slice_id", "y_true", "y_pred", "score", "model")
    B.write_predictions(p, path, "model")
    manifests = p.select("model").distinct().select("model", F.concat(F.lit("family_"), "model").alias("family"), F.length("model").alias("ratio"))
    manifests.repartition("model").write.mode("append").partitionBy("model").json(path)
    read = B.with_manifest(B.read_predictions(spark, path), B.read_manifests(spark, path), "family string, ratio int")
    return read.withColumn("model", F.regexp_extract("folder", "model=([^/]+)", 1)).drop("folder")


@query("A9", "SELECT obs_name, slice_id, y_true, y_pred, score, model, 'family_' || model AS family, length(model)::INT AS ratio FROM pred")
def a9(spark, sf):
    return _scanned(spark, sf)


@query("A28", "SELECT label, count(*) AS n FROM spots GROUP BY label")
def a28(spark, sf):
    path = B.scratch(spark, "manifests")
    B.write_manifest(spots(spark, sf).groupBy("label").agg(F.count("*").alias("n")), path)
    return spark.read.schema("label string, n long").json(path)


@query("A20", "SELECT obs_name AS barcode, pos * 2.0 AS pixel_row, pos * 3.0 AS pixel_col FROM spots")
def a20(spark, sf):
    path = B.scratch(spark, "positions")
    p = F.col("pos")
    spots(spark, sf).select("obs_name", F.lit(1), p.alias("r"), p.alias("c"), p * 2.0, p * 3.0).toDF("a", "b", "c", "d", "e", "f").write.csv(path)
    return B.read_positions(spark, path).select("barcode", "pixel_row", "pixel_col")


@query("A21", "SELECT obs_name AS key, [round(list_sum(vec) / 64, 4) + 0, round(list_max(vec), 4) + 0]::DOUBLE[] AS embedding FROM spots")
def a21(spark, sf):
    patches = spots(spark, sf).select(F.col("obs_name").alias("key"), F.col("vec").alias("pixels"))
    out = B.embed_patches(patches, lambda: lambda x: np.stack([x.mean(axis=1), x.max(axis=1)], axis=1), 2)
    return out.select("key", F.transform("embedding", lambda v: F.round(v.cast("double"), 4) + 0.0).alias("embedding"))


@query("A31", "SELECT DISTINCT model, ratio FROM pred WHERE ratio IS NOT NULL AND model <> 'click'")
def a31(spark, sf):
    variants = predictions(spark, sf).where("ratio is not null").select("model", "ratio").distinct()
    return B.unfinished(variants, spark.createDataFrame([("click",)], "model string"), "model")


@query("A10", f", {_PER.format(g='model')}, {_CLS.format(g='model', d=6)} SELECT 'family_' || model AS family, n::BIGINT AS n, accuracy, balanced_accuracy, macro_f1, weighted_f1, mcc FROM cls")
def a10(spark, sf):
    """All prediction folders in one scan, measured by what their manifests say."""
    return M.classification(_scanned(spark, sf), ["family"])


@query("A25", "SELECT spot, gene_idx, value FROM expr")
def a25(spark, sf):
    path = B.scratch(spark, "expr")
    B.write_bundle({"expr": expr(spark, sf)}, path)
    return B.read_bundle(spark, path, "expr")["expr"]


@query("K1", "SELECT ratio, n FROM (SELECT 0.5 AS ratio, count(*) AS n FROM real UNION ALL SELECT 1.0, count(*) FROM real) t".replace("0.5 AS", "0.5::DOUBLE AS"))
def k1(spark, sf):
    path = B.scratch(spark, "packages")
    sink = lambda df, p: df.agg(F.count("*").alias("n")).withColumn("ratio", F.lit(p["ratio"])).write.mode("append").parquet(path)
    monitor.run_packages([{"ratio": 0.5}, {"ratio": 1.0}], lambda ratio: real(spark, sf), sink)
    return spark.read.parquet(path)


@query("K_monitor", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, 'L' || (event_id % 3) AS y_true, 'L' || (user_id % 3) AS y_pred, count(*) AS n FROM events GROUP BY ALL")
def k_monitor(spark, sf):
    label = lambda c: F.concat(F.lit("L"), F.col(c) % 3)
    e = table(spark, sf, "events").select("ts", "event_type", label("event_id").alias("y_true"), label("user_id").alias("y_pred"))
    return monitor.windowed_confusion(e, "ts", "1 hour", "10 minutes", ["event_type"])


@query("L1", """, n AS (SELECT count(*) AS n FROM real), syn AS (SELECT obs_name FROM (SELECT obs_name, row_number() OVER (ORDER BY md5('42||' || obs_name), obs_name) AS r FROM pool) JOIN n ON r <= n)
SELECT 'real_baseline' AS paradigm, obs_name, 'real' AS augmentation_source, 1.0::DOUBLE AS loss_weight FROM real UNION ALL SELECT 'weighted_erm', obs_name, 'real', round(0.5 / (SELECT count(*) FROM real), 9) FROM real
UNION ALL SELECT 'weighted_erm', obs_name, 'synthetic', round(0.5 / (SELECT count(*) FROM syn), 9) FROM syn""")
def l1(spark, sf):
    """Each known paradigm builds its package from the same rows."""
    from ..operators import paradigm

    r, p = (df.withColumn("label", F.lit("all")) for df in (real(spark, sf), spots(spark, sf).where("source = 'synthetic'")))
    out = None
    for name in ("real_baseline", "weighted_erm"):
        package = paradigm.builder(name)(r, p, 1.0, 0.5, 42).select(F.lit(name).alias("paradigm"), "obs_name", "augmentation_source", F.round("loss_weight", 9).alias("loss_weight"))
        out = package if out is None else out.unionByName(package)
    return out
