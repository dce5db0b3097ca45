"""Queries for readers with rules, contracts of generators and the fidelity row."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as X
from ..operators import fidelity as Q
from ..sources import bundle as B
from ..sources import loaders as L
from ..sources import package as K
from .registry import pool, predictions, query, real, spots
from .spatial_queries import _D

_JSD = "sum(a * log2(2 * a / (a + b)) + b * log2(2 * b / (a + b))) / 2"


def _shares(name: str, bins: int, by: str) -> str:
    """Shares of bins of both sides, side by side."""
    keys = f"{by}, " if by else ""
    return f"""{name}c AS (SELECT source, {keys}least(floor(v * {bins} / t), {bins - 1}) AS bin, count(*) AS n FROM x, top GROUP BY ALL), {name}t AS (SELECT source, {keys}sum(n) AS total FROM {name}c GROUP BY ALL), {name}g AS (SELECT *, unnest(range(0, {bins})) AS bin FROM {name}t),
{name} AS (SELECT {keys}bin, max(p) FILTER (source = 'real') AS a, max(p) FILTER (source <> 'real') AS b FROM (SELECT g.*, (coalesce(c.n, 0) + 1e-8) / (total + {bins} * 1e-8) AS p FROM {name}g g LEFT JOIN {name}c c ON g.source = c.source AND g.bin = c.bin{' AND g.gene = c.gene' if by else ''}) GROUP BY ALL)"""


@query("E14", f""", x AS (SELECT source, slice_id, obs_name, k AS gene, greatest(vec[k], 0) AS v FROM spots, (SELECT unnest(range(1, 65)) AS k)), top AS (SELECT greatest(max(v), 1) AS t FROM x),
{_shares('h', 50, '')}, {_shares('w', 30, 'gene')}, gj AS (SELECT gene, {_JSD} AS j FROM w GROUP BY gene),
gs AS (SELECT source, gene, avg(v) AS mean, var_pop(v) AS var, avg((v = 0)::INT) AS zero, count(*) AS n FROM x GROUP BY ALL), bg AS (SELECT r.gene, r.mean AS mr, s.mean AS ms, r.var AS vr, s.var AS vs, r.zero AS zr, s.zero AS zs, r.n AS nr, s.n AS ns FROM gs r JOIN gs s ON r.gene = s.gene AND r.source = 'real' AND s.source <> 'real'),
lib AS (SELECT source, obs_name, sum(v) AS l FROM x GROUP BY ALL), lv AS (SELECT round(l, 9) AS l, sum((source = 'real')::INT) AS na, sum((source <> 'real')::INT) AS nb FROM lib GROUP BY 1),
lf AS (SELECT l, sum(na) OVER (ORDER BY l) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY l) / sum(nb) OVER () AS fb, lead(l) OVER (ORDER BY l) - l AS step FROM lv),
rk AS (SELECT source, l, row_number() OVER (PARTITION BY source ORDER BY l) AS r FROM lib), pr AS (SELECT a.l AS a, b.l AS b FROM rk a JOIN rk b ON a.r = b.r AND a.source = 'real' AND b.source <> 'real'),
nn AS (SELECT source, src, dst FROM (SELECT a.source, a.obs_name AS src, b.obs_name AS dst, row_number() OVER (PARTITION BY a.obs_name ORDER BY {_D}, b.obs_name) AS r FROM spots a JOIN spots b ON a.slice_id = b.slice_id AND a.source = b.source AND a.obs_name <> b.obs_name) WHERE r <= 6),
z AS (SELECT source, obs_name, gene, v - avg(v) OVER (PARTITION BY source, gene) AS z FROM x), ss AS (SELECT source, gene, count(*) AS n, sum(z * z) AS ss FROM z GROUP BY ALL),
mo AS (SELECT nn.source, a.gene, any_value(n) * sum(a.z * b.z) / (count(*) * any_value(ss)) AS m FROM nn JOIN z a ON a.obs_name = src JOIN z b ON b.obs_name = dst AND a.gene = b.gene JOIN ss ON ss.source = nn.source AND ss.gene = a.gene WHERE ss > 0 GROUP BY ALL),
mm AS (SELECT avg(m) FILTER (source = 'real') AS r, avg(m) FILTER (source <> 'real') AS s FROM mo)
SELECT (SELECT count(*) FROM bg) AS n_genes, (SELECT max(nr) FROM bg) AS n_real, (SELECT max(ns) FROM bg) AS n_synthetic, (SELECT round(avg(zs) - avg(zr), 8) FROM bg) AS fraction_zero_delta, (SELECT round(avg(abs(ms - mr)), 8) FROM bg) AS mean_gene_mean_abs_diff,
(SELECT round(avg(abs(vs - vr)), 8) FROM bg) AS mean_gene_var_abs_diff, (SELECT round({_JSD}, 8) FROM h) AS global_jsd, (SELECT round(avg(j), 8) FROM gj) AS mean_gene_jsd, (SELECT round(quantile_cont(j, 0.5), 8) FROM gj) AS median_gene_jsd,
(SELECT round(ln(1 + avg(l) FILTER (source <> 'real')) - ln(1 + avg(l) FILTER (source = 'real')), 8) FROM lib) AS library_size_log_ratio, (SELECT round(sum(abs(fa - fb) * step), 8) FROM lf) AS library_size_wasserstein,
(SELECT round(corr(mr, ms), 8) FROM bg) AS gene_mean_correlation, (SELECT round(corr(vr, vs), 8) FROM bg) AS gene_variance_correlation, (SELECT round(corr(a, b), 8) FROM pr) AS spot_total_correlation,
round(r, 8) AS mean_morans_i_real, round(s, 8) AS mean_morans_i_synthetic, round(abs(s - r), 8) AS morans_i_abs_diff FROM mm""")
def e14(spark, sf):
    return Q.fidelity(real(spark, sf), pool(spark, sf), places=8)


#: Two wide tables that share some columns.
@query("A2", "SELECT 'one' AS sample, obs_name, v[3] AS g3, v[4] AS g4 FROM (SELECT obs_name, vec AS v FROM real) UNION ALL SELECT 'two', obs_name, v[3], v[4] FROM (SELECT obs_name, vec AS v FROM pool)")
def a2(spark, sf):
    root = B.scratch(spark, "wide")
    for name, df, genes in (("one", real(spark, sf), (1, 2, 3, 4)), ("two", pool(spark, sf), (4, 3, 6))):
        df.select("obs_name", *(F.col("vec")[g - 1].alias(f"g{g}") for g in genes)).write.parquet(f"{root}/{name}")
    return L.common_columns(spark, {n: f"{root}/{n}" for n in ("one", "two")}, ["obs_name"])


@query("A6", "SELECT s.obs_name AS barcode, s.label, s.vec AS rna, CASE WHEN s.pos % 3 = 0 THEN [s.x, s.y] END AS protein, s.pos % 3 = 0 AS has_protein FROM spots s WHERE s.pos % 5 <> 0")
def a6(spark, sf):
    s = spots(spark, sf).withColumnRenamed("obs_name", "barcode")
    rna = s.where("pos % 5 != 0").select("barcode", F.col("vec").alias("vector"))
    protein = s.where("pos % 3 = 0").select("barcode", F.array("x", "y").alias("vector"))
    return L.two_modalities(rna, s.select("barcode", "label"), protein)


@query("A8", "SELECT obs_name, slice_id, label, x, y, CASE WHEN slice_id = 's3' THEN 'test' ELSE 'train' END AS split FROM spots WHERE slice_id <> 's2'")
def a8(spark, sf):
    tables = K.split_tables(spots(spark, sf).select("obs_name", "slice_id", "label", "x", "y"), ["s0", "s1"], ["s3"], "t")
    K.write_package(spark, path := B.scratch(spark, "split"), tables)
    return L.split_data(spark, path).drop("split_tag")


@query("A11", "SELECT obs_name, label FROM spots")
def a11(spark, sf):
    """A label file whose first column has the names and whose last has the labels, under other headers."""
    path = B.scratch(spark, "labels")
    spots(spark, sf).select(F.col("obs_name").alias("barcode"), "x", F.col("label").alias("layer")).write.option("header", True).csv(path)
    return L.evaluation_labels(spark, path)


@query("A13", "SELECT DISTINCT lpad((user_id % 40)::VARCHAR, 4, '0') AS sample_id, CASE WHEN user_id % 40 < 30 THEN 'train' ELSE 'test' END AS split FROM events")
def a13(spark, sf):
    path = B.scratch(spark, "splits")
    s = predictions(spark, sf).sparkSession.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") % 40).alias("u")).distinct()
    s.select(F.lpad(F.col("u").cast("string"), 4, "0").alias("sample_id"), F.when(F.col("u") < 30, "train").otherwise("test").alias("split")).write.option("header", True).csv(path)
    return L.split_table(spark, path)


@query("A39", "SELECT slice_id || '_' || label AS region, count(*) / 100 AS alpha FROM real GROUP BY ALL")
def a39(spark, sf):
    path = B.scratch(spark, "alphas")
    real(spark, sf).groupBy(F.concat_ws("_", "slice_id", "label").alias("region_id")).agg((F.count("*") / 100).alias("alpha")).write.option("header", True).csv(path)
    return L.regional_alphas(spark, path)


@query("B6", "SELECT obs_name, label FROM spots")
def b6(spark, sf):
    """What was kept apart for evaluation; the rows that go on have no label column."""
    path = B.scratch(spark, "evaluation")
    clean = L.without_labels(spots(spark, sf), path)
    kept = K.read_package(spark, path)[0]["labels"]
    return kept.join(clean.select("obs_name"), "obs_name", "left_semi")


@query("C14", """, r AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'unsupervised' ELSE 'supervised' END AS mode, CASE WHEN event_id % 5 > 0 THEN 'L' || (event_id % 5) END AS label, CASE WHEN user_id % 3 = 0 THEN 'L' || (event_id % 4) END AS own, user_id % 4 AS kind FROM events),
s AS (SELECT *, coalesce(label, own) AS wanted, coalesce(label <> own, false) AS clash, CASE WHEN kind = 0 THEN 'label_wise_generation' WHEN kind = 1 AND coalesce(label, own) IN ('L1', 'L2') THEN 'conditional_generation' WHEN kind = 2 AND coalesce(label, own) IN ('L2', 'L3') THEN 'classifier_guidance' END AS strategy FROM r),
e AS (SELECT *, mode = 'supervised' AND wanted IS NOT NULL AS asked, CASE WHEN clash THEN 'label is not the checkpoint''s' WHEN mode = 'supervised' AND wanted IS NOT NULL AND strategy IS NULL THEN 'no trusted condition' END AS error FROM s)
SELECT event_id, CASE WHEN asked AND error IS NULL THEN wanted END AS label, CASE WHEN asked AND error IS NULL THEN strategy END AS strategy, error FROM e""")
def c14(spark, sf):
    e, u = F.col("event_id"), F.col("user_id")
    none = F.lit(None).cast("string")
    kind, classes = u % 4, lambda on, *c: F.when(on, F.array(*(F.lit(x) for x in c)))
    checkpoint = F.struct(
        F.when(u % 3 == 0, F.concat(F.lit("L"), e % 4)).alias("label_condition"),
        F.when(kind == 0, "label_wise_generation").otherwise(none).alias("label_strategy"),
        (kind == 1).alias("conditional"),
        F.when(kind == 1, "label").alias("conditional_key"),
        classes(kind == 1, "L1", "L2").alias("condition_classes"),
        F.when(kind == 2, "label").alias("classifier_key"),
        classes(kind == 2, "L2", "L3").alias("classifier_classes"),
    )
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.when(e % 7 == 0, "unsupervised").otherwise("supervised").alias("mode"), F.when(e % 5 > 0, F.concat(F.lit("L"), e % 5)).alias("label"), checkpoint.alias("checkpoint"))
    return rows.select("event_id", L.label_condition(F.col("mode"), F.col("label"), F.col("checkpoint")).alias("c")).select("event_id", "c.*")


@query("C25", "SELECT DISTINCT slice_id FROM spots WHERE pos % 4 > 1 AND slice_id <> 's2'")
def c25(spark, sf):
    split = F.when(F.col("slice_id") == "s2", "test").when(F.col("pos") % 4 > 1, "train").otherwise("all")
    return L.unsupervised_slices(spots(spark, sf).drop("label").withColumn("split", split))


@query("H4", ", d AS (SELECT *, CASE WHEN label IN ('L1', 'L2') THEN label ELSE label || slice_id END AS path FROM pool) SELECT obs_name, slice_id, path FROM d SEMI JOIN (SELECT path FROM d GROUP BY path HAVING count(DISTINCT slice_id) = 1) USING (path)")
def h4(spark, sf):
    """Data sets of one slice, merged and written slice by slice, read back; those that mix slices are left out."""
    path = F.when(F.col("label").isin("L1", "L2"), F.col("label")).otherwise(F.concat("label", "slice_id"))
    merged = L.of_one_slice(pool(spark, sf).select("obs_name", "slice_id", path.alias("path")))
    merged.write.partitionBy("slice_id").parquet(out := B.scratch(spark, "per-slice"))
    return spark.read.parquet(out).select("obs_name", "slice_id", "path")


@query("C19", "SELECT obs_name, (pos % 4 - 1)::DOUBLE AS w FROM spots WHERE pos % 4 > 1")
def c19(spark, sf):
    return X.positive_rows(spots(spark, sf).withColumn("weight", F.col("pos") % 4 - 1), "weight").select("obs_name", F.col("_w").alias("w"))


@query("N3", "SELECT slice_id, label, greatest(1, least(50, count(*) - 1, 64))::INT AS components FROM spots GROUP BY ALL")
def n3(spark, sf):
    return X.component_counts(spots(spark, sf), ["slice_id", "label"], "vec", 50)


_ZERO = "z AS (SELECT obs_name, k, vec[k] - avg(vec[k]) OVER (PARTITION BY k) AS v FROM spots, (SELECT unnest(range(1, 65)) AS k))"


@query("K3", f", {_ZERO} SELECT obs_name, round(sum(v * v), 4) AS norm2 FROM z GROUP BY obs_name")
def k3(spark, sf):
    """Rows are projected batch by batch; all components keep the length of a centred row."""
    s = spots(spark, sf)
    out = X.pca(s, "vec", 64).transform(s, "vec")
    return out.select("obs_name", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v), 4).alias("norm2"))
