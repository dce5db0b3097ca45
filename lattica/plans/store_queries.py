"""Queries for variable genes, packages and resumable evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import variable as V
from ..sources import bundle as B
from ..sources import package as K
from ..streaming import evaluation as E
from .metric_queries import _CLS, _PER
from .registry import pool, predictions, query, real, spots, table

_COUNTS = "cnt AS (SELECT l_orderkey % 400 AS spot, l_partkey AS gene_idx, sum(l_quantity::DOUBLE) AS value FROM lineitem GROUP BY ALL), size AS (SELECT count(DISTINCT spot)::DOUBLE AS n FROM cnt)"
_MOMENTS = f"{_COUNTS}, m AS (SELECT gene_idx, n, sum(value) / n AS mean, (var_pop(value) * count(*) + pow(avg(value), 2) * count(*) * (n - count(*)) / n) / (n - 1) AS variance FROM cnt, size GROUP BY gene_idx, n)"


def _gene_counts(spark, sf):
    """Raw counts of every part in 400 spots."""
    return table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 400).alias("spot"), F.col("l_partkey").alias("gene_idx")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def _rounded(scores):
    return scores.select("gene_idx", *(F.round(c, 6).alias(c) for c in ("mean", "variance")), F.round("score", 5).alias("score"), "highly_variable")


@query("G8", f""", {_MOMENTS}, g AS (SELECT gene_idx, log10(mean) AS x, log10(variance) AS y FROM m WHERE variance > 0 AND mean > 0),
q AS (SELECT greatest(floor(0.3 * count(*)), 1) AS q FROM g),
d AS (SELECT a.gene_idx, b.x - a.x AS u, b.y, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.gene_idx ORDER BY abs(b.x - a.x)) AS r FROM g a, g b),
h AS (SELECT gene_idx, max(d) FILTER (r <= q) AS h FROM d, q GROUP BY gene_idx),
w AS (SELECT gene_idx, u / h AS u, y, pow(1 - pow(d / h, 3), 3) AS w FROM d JOIN h USING (gene_idx) WHERE d < h),
s AS (SELECT gene_idx, sum(w) AS s0, sum(w * u) AS s1, sum(w * u * u) AS s2, sum(w * pow(u, 3)) AS s3, sum(w * pow(u, 4)) AS s4, sum(w * y) AS t0, sum(w * u * y) AS t1, sum(w * u * u * y) AS t2 FROM w GROUP BY gene_idx),
f AS (SELECT gene_idx, pow(10, (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - t2 * s3) + s2 * (t1 * s3 - t2 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2)) / 2) AS sd FROM s),
e AS (SELECT gene_idx, n, mean, variance, sd, mean + sd * sqrt(n) AS top FROM m JOIN f USING (gene_idx)),
z AS (SELECT gene_idx, (n * mean * mean + sum(pow(least(value, top), 2)) - 2 * mean * sum(least(value, top))) / ((n - 1) * sd * sd) AS score FROM cnt JOIN e USING (gene_idx) GROUP BY gene_idx, n, mean, sd),
a AS (SELECT gene_idx, mean, variance, coalesce(score, 0) AS score FROM m LEFT JOIN z USING (gene_idx))
SELECT gene_idx, round(mean, 6) AS mean, round(variance, 6) AS variance, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC, gene_idx) <= 100 AS highly_variable FROM a""")
def g8(spark, sf):
    return _rounded(V.top_genes(V.stabilised_variance(_gene_counts(spark, sf)), 100))


@query("G8_binned", f""", {_MOMENTS}, x AS (SELECT *, ln(1 + mean) AS x, CASE WHEN variance > 0 THEN ln(variance / mean) END AS d FROM m),
b AS (SELECT *, greatest(ceil((x - min(x) OVER ()) / ((max(x) OVER () - min(x) OVER ()) / 20)), 1) AS bin FROM x),
z AS (SELECT *, CASE WHEN stddev_samp(d) OVER (PARTITION BY bin) IS NULL AND d IS NOT NULL THEN 1 ELSE (d - avg(d) OVER (PARTITION BY bin)) / nullif(stddev_samp(d) OVER (PARTITION BY bin), 0) END AS score FROM b)
SELECT gene_idx, round(mean, 6) AS mean, round(variance, 6) AS variance, round(score, 5) AS score, row_number() OVER (ORDER BY score DESC NULLS LAST, gene_idx) <= 100 AS highly_variable FROM z""")
def g8_binned(spark, sf):
    return _rounded(V.top_genes(V.binned_dispersion(_gene_counts(spark, sf)), 100))


_CLUSTERED = "obs_name, slice_id, label, x AS spatial_x, y AS spatial_y, source AS augmentation_source, 'c' || (pos % 7) AS pred_cluster"


@query("A29", "SELECT 'pretrain_synthetic' AS part, obs_name, slice_id, label, vec, 'weighted' AS paradigm_family, 'ratio2_alpha0p5' AS variant_id, 2.0::DOUBLE AS synthetic_ratio FROM pool UNION ALL SELECT 'finetune_real', obs_name, slice_id, label, vec, 'weighted', 'ratio2_alpha0p5', 2.0::DOUBLE FROM real")
def a29(spark, sf):
    root = B.scratch(spark, "training")
    cols = ["obs_name", "slice_id", "label", "vec"]
    path = K.write_training_package(spark, root, "weighted", "ratio2_alpha0p5", {"synthetic_ratio": 2.0}, pretrain=pool(spark, sf).select(*cols), finetune=real(spark, sf).select(*cols))
    tables, info = K.read_package(spark, path, verify=True)
    both = [df.select(F.lit(n).alias("part"), *cols) for n, df in tables.items()]
    return both[0].unionByName(both[1]).withColumns({k: F.lit(info[k]) for k in ("paradigm_family", "variant_id", "synthetic_ratio")})


@query("A30", f"""SELECT {_CLUSTERED}, count(*) OVER s AS n_obs, count(*) FILTER (source = 'real') OVER s AS n_real, count(*) FILTER (source = 'synthetic') OVER s AS n_synthetic, 'global' AS ablation, 'pca' AS downstream_backend, 42::INT AS cluster_seed,
'gan' AS model, 'global_concat' AS paradigm_family, 'ratio1' AS variant_id, 1.0::DOUBLE AS synthetic_ratio, 1.0::DOUBLE AS real_fraction, 'label' AS condition_source FROM spots WINDOW s AS (PARTITION BY slice_id)""")
def a30(spark, sf):
    rows = spots(spark, sf).select("obs_name", "slice_id", "label", "x", "y", F.col("source").alias("augmentation_source"), F.concat(F.lit("c"), F.col("pos") % 7).alias("pred_cluster"))
    manifest = {"generator": "gan", "paradigm_family": "global_concat", "variant_id": "ratio1", "synthetic_ratio": 1.0, "condition_source": "label"}
    result = K.cluster_result(rows, manifest, "global", "pca", 42)
    K.write_package(spark, path := B.scratch(spark, "clusters"), {"spatial_clusters": result}, manifest)
    return K.read_package(spark, path, verify=True)[0]["spatial_clusters"]


_SPLIT = "split AS (SELECT *, CASE WHEN slice_id IN ('s0', 's1') THEN 'train' ELSE 'test' END AS split, 'two_to_one' AS split_tag FROM spots WHERE slice_id <> 's3')"


def _split(spark, sf, name):
    tables = K.split_tables(spots(spark, sf), ["s0", "s1"], ["s2"], "two_to_one")
    K.write_package(spark, path := B.scratch(spark, "split"), tables, {"split_tag": "two_to_one"})
    return K.read_package(spark, path, verify=True)[0][name]


@query("A37", f", {_SPLIT} SELECT * FROM split")
def a37(spark, sf):
    return _split(spark, sf, "data")


@query("A37_summary", f", {_SPLIT} SELECT split, slice_id, label, count(*) AS n_spots FROM split GROUP BY ALL")
def a37_summary(spark, sf):
    return _split(spark, sf, "summary")


@query("A37_index", f", {_SPLIT} SELECT obs_name, slice_id, label, split, split_tag FROM split")
def a37_index(spark, sf):
    return _split(spark, sf, "index")


#: Prediction files by model and seed. Those of seed 2 lack a header; the last model has no reference.
@query("A32", f""", {_PER.format(g='model, seed')}, {_CLS.format(g='model, seed', d=6)}, st AS (SELECT model, seed, CASE WHEN model = (SELECT max(event_type) FROM events) THEN 'skipped' WHEN seed = 2 THEN 'failed' ELSE 'ok' END AS status FROM pred GROUP BY ALL)
SELECT model, seed, status, CASE status WHEN 'skipped' THEN 'missing_reference' WHEN 'failed' THEN 'header is not obs_name,slice_id,y_true,y_pred,score' ELSE '' END AS reason,
CASE WHEN status = 'ok' THEN n::BIGINT END AS n, CASE WHEN status = 'ok' THEN accuracy END AS accuracy, CASE WHEN status = 'ok' THEN macro_f1 END AS macro_f1 FROM st JOIN cls USING (model, seed)""")
def a32(spark, sf):
    p = predictions(spark, sf).select("obs_name", "slice_id", "y_true", "y_pred", "score", "model", "seed").repartition("model", "seed")
    root = B.scratch(spark, "prediction-files")
    for header in (True, False):
        p.where((F.col("seed") != 2) == header).write.mode("append").partitionBy("model", "seed").option("header", header).csv(root)
    models = table(spark, sf, "events").select(F.col("event_type").alias("reference")).distinct()
    references = models.join(models.agg(F.max("reference").alias("reference")), "reference", "left_anti")
    part = lambda c, k: F.regexp_extract(c, f"/{k}=([^/]+)/", 1)
    E.evaluate_files(spark, root, out := f"{root}-flushed", f"{root}-checkpoint", B.PREDICTIONS, lambda path: part(path, "model"), references, lambda rows: M.classification(rows, ["path"]), files_at_once=8)
    return E.evaluations(spark, out).select(part("path", "model").alias("model"), part("path", "seed").cast("int").alias("seed"), "status", "reason", "n", "accuracy", "macro_f1")
