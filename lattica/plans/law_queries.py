"""Queries for count laws, tables of methods, slice pools and cluster results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fits as P
from ..operators import methods as M
from ..operators import paradigm as R
from ..sources import bundle as B
from ..sources import loaders as L
from .registry import expr, pool, predictions, query, real

#: Small counts with zeros: every third unit of expression is taken out, the rest is cut to tens.
_X = "x AS (SELECT spot, spot % 4 AS domain, gene_idx AS gene, CASE WHEN value % 3 = 0 THEN 0 ELSE floor(value / 20) END AS value FROM expr)"


def _x(spark, sf):
    v = F.col("value")
    return expr(spark, sf).select("spot", (F.col("spot") % 4).alias("domain"), F.col("gene_idx").alias("gene"), F.when(v % 3 == 0, F.lit(0.0)).otherwise(F.floor(v / 20).cast("double")).alias("value"))


def _rounded(df, keys, *columns, places=4):
    return df.select(*keys, *(F.round(c, places).alias(c) for c in columns))


@query("E32b")
def e32b(spark, sf):
    return _rounded(P.fit_laws(_x(spark, sf), ["gene"], law="nb"), ["gene", "law"], "mean", "theta", "loglik")


_STEPS = ", ".join(f"s{k + 1} AS (SELECT * REPLACE (r - (r - m * (1 - exp(-r))) / (1 - m * exp(-r)) AS r) FROM s{k})" for k in range(P.ZIP_ROUNDS))


@query("E32c", f""", {_X}, a AS (SELECT domain, gene, count(*)::DOUBLE AS n, count(*) FILTER (value = 0)::DOUBLE AS zeros, sum(value) AS total FROM x GROUP BY ALL),
b AS (SELECT *, CASE WHEN n > zeros THEN total / (n - zeros) ELSE 0 END AS m FROM a), s0 AS (SELECT *, m AS r FROM b WHERE m > 1), {_STEPS},
j AS (SELECT b.*, s.r, greatest(coalesce((b.zeros / b.n - exp(-s.r)) / (1 - exp(-s.r)), 0), 0) AS p0 FROM b LEFT JOIN s{P.ZIP_ROUNDS} s ON b.domain = s.domain AND b.gene = s.gene),
k AS (SELECT *, CASE WHEN p0 > 0 THEN r ELSE total / n END AS rate FROM j)
SELECT domain, gene, CASE WHEN p0 > 0 THEN 'zip' ELSE 'poisson' END AS law, round(rate, 6) AS rate, round(p0, 6) AS p0,
round(zeros * ln(greatest(p0 + (1 - p0) * exp(-rate), 1e-300)) + (n - zeros) * (ln(1 - p0) - rate) + total * ln(greatest(rate, 1e-12)), 4) AS kernel FROM k""")
def e32c(spark, sf):
    return P.fit_zip(_x(spark, sf), ["domain", "gene"]).select("domain", "gene", "law", F.round("rate", 6).alias("rate"), F.round("p0", 6).alias("p0"), F.round("kernel", 4).alias("kernel"))


@query("E32d")
def e32d(spark, sf):
    return _rounded(P.fit_laws(_x(spark, sf), ["gene"], law="zinb"), ["gene", "law"], "mean", "theta", "p0", "loglik")


@query("E32f")
def e32f(spark, sf):
    x = _x(spark, sf)
    sizes = x.groupBy("domain").agg(F.countDistinct("spot").alias("n_spots"))
    return _rounded(P.fit_domains(x.where("value > 0"), "domain", "gene", sizes), ["domain", "gene", "n_nonzero", "law"], "mean", "theta", "p0", "loglik")


@query("E32g")
def e32g(spark, sf):
    return _rounded(P.dropout_curves(_x(spark, sf), ["domain"], "gene"), ["domain", "n_genes"], "x0", "k")


_RIGHT = "m AS (SELECT slice_id, model, seed, avg((y_true = y_pred)::INT) AS accuracy, avg(score) AS score FROM pred GROUP BY ALL), s AS (SELECT slice_id, model, avg(accuracy) AS accuracy, avg(score) AS score FROM m GROUP BY ALL)"


def _by_seed(spark, sf):
    return predictions(spark, sf).groupBy("slice_id", "model", "seed").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"), F.avg("score").alias("score"))


@query("E42_slices", f", {_RIGHT} SELECT slice_id, model, round(accuracy, 4) AS accuracy, round(score, 4) AS score FROM s")
def e42_slices(spark, sf):
    return M.by_slice(_by_seed(spark, sf), "slice_id", "model", ["accuracy", "score"])


@query("E42", f""", {_RIGHT}, o AS (SELECT model, round(avg(accuracy), 4) AS accuracy_mean, round(stddev_samp(accuracy), 4) AS accuracy_std, round(avg(score), 4) AS score_mean, round(stddev_samp(score), 4) AS score_std FROM m GROUP BY model),
d AS (SELECT s.model, round(s.accuracy - b.accuracy, 4) AS a, round(s.score - b.score, 4) AS c FROM s JOIN s b ON s.slice_id = b.slice_id AND b.model = 'click' AND s.model <> 'click'),
e AS (SELECT model, round(avg(a), 4) AS accuracy_delta, round(stddev_samp(a), 4) AS accuracy_delta_std, round(avg(c), 4) AS score_delta, round(stddev_samp(c), 4) AS score_delta_std FROM d GROUP BY model)
SELECT o.*, e.* EXCLUDE (model) FROM o LEFT JOIN e ON o.model = e.model""")
def e42(spark, sf):
    return M.against(_by_seed(spark, sf), "slice_id", "model", ["accuracy", "score"], "click")


@query("A36", """, w AS (SELECT DISTINCT slice_id, seed, obs_name, y_pred FROM pred WHERE seed < 2)
SELECT w.slice_id AS slice, 'seed_' || w.seed AS run, w.obs_name, w.y_pred AS cluster, r.y_true AS label FROM w JOIN pred r ON w.obs_name = r.obs_name""")
def a36(spark, sf):
    root = B.scratch(spark, "clusters")
    rows = predictions(spark, sf)
    for k in (0, 1):
        out = rows.where(F.col("seed") == k).select("obs_name", F.col("y_pred").alias("cluster"), "slice_id", F.lit(f"seed_{k}").alias("run"), F.lit("spatial_clusters.csv").alias("leaf"))
        out.write.mode("append").partitionBy("slice_id", "run", "leaf").option("header", True).csv(root)
        # a table of another kind beside it does not count
        out.limit(1).withColumn("leaf", F.lit("summary.csv")).write.mode("append").partitionBy("slice_id", "run", "leaf").option("header", True).csv(root)
    rows.select(F.col("obs_name").alias("barcode"), F.lit(1).alias("n"), F.col("y_true").alias("label")).write.option("header", True).csv(labels := B.scratch(spark, "labels"))
    found = L.cluster_results(spark, root)
    return found.join(L.evaluation_labels(spark, labels), "obs_name").select(F.col("parts")[0].alias("slice"), F.col("parts")[1].alias("run"), "obs_name", "cluster", "label")


@query("H9", """, p AS (SELECT slice_id, label, obs_name, x, y FROM pool), n AS (SELECT slice_id, label, count(*) AS n FROM real GROUP BY ALL)
SELECT 'syn_splat_' || p.slice_id || '_' || p.label || '_' || (row_number() OVER (PARTITION BY p.slice_id, p.label ORDER BY obs_name) - 1) AS obs_name, p.slice_id, p.label, p.label AS condition_label, 'synthetic' AS source, 'splat' AS generator,
coalesce(n, 0) AS n_real_train_condition, 'fold_1' AS split_tag, 7 AS random_seed, 2.0::DOUBLE AS pool_ratio, 'slice_conditional' AS generation_scope, 'label' AS condition_key, x, y FROM p LEFT JOIN n ON p.slice_id = n.slice_id AND p.label = n.label""")
def h9(spark, sf):
    drawn = pool(spark, sf).select("slice_id", "label", F.col("obs_name").alias("drawn"), "x", "y")
    return R.slice_pool(drawn, real(spark, sf), "splat", "fold_1", 7, 2.0, order="drawn")
