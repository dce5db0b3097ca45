"""Queries for discovery, caches and meta genes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import meta as G
from ..operators import paradigm as P
from ..sources import bundle as B
from ..sources import cache as C
from ..sources import discovery as D
from .registry import expr, pool, predictions, query, real, spots
from .table_queries import _M4

_TASK = "CASE n % 3 WHEN 0 THEN 'spatial_cluster' WHEN 1 THEN 'cross_slice_generalization' ELSE 'supervised_low_label' END"
#: The tree that _tree writes: pools by slice in two layouts, whole, and by condition.
_TREE = f"""t AS (SELECT DISTINCT label, slice_id, substr(label, 2)::INT AS n FROM spots),
p AS (SELECT label, slice_id, n, CASE WHEN n % 2 = 0 THEN 'DLPFC' ELSE 'Kidney' END AS cohort, {_TASK} || '/' || CASE WHEN n % 2 = 0 THEN 'DLPFC' ELSE 'Kidney' END || '/' || label || '/fixed_2/pool_40x' AS pool FROM t),
tree AS (SELECT p.*, 'folder' AS kind, pool || '/' || slice_id || '/synthetic' AS rel FROM p WHERE n % 3 = 0
  UNION ALL SELECT p.*, 'slices', pool || '/slices/slice_' || slice_id FROM p WHERE n % 3 = 1 OR n % 3 = 0 AND slice_id = 's0'
  UNION ALL SELECT DISTINCT label, NULL, n, cohort, pool, 'whole', pool || '/synthetic_pool_40x' FROM p
  UNION ALL SELECT DISTINCT label, NULL, n, cohort, pool, 'conditions', pool || '/conditions/' || label || '/synthetic' FROM p WHERE n % 3 = 2)"""
_CHOSEN = f"{_TREE}, chosen AS (SELECT *, CASE WHEN kind = 'whole' THEN 'whole' ELSE 'by_slice' END AS rule FROM tree WHERE CASE WHEN cohort = 'DLPFC' AND n % 3 < 2 THEN kind IN ('folder', 'slices') ELSE kind = 'whole' END)"


def _tree(spark, sf):
    """The listing of a tree of generated pools that is written from the spots."""
    root = B.scratch(spark, "pools")
    n = F.substring("label", 2, 9).cast("int")
    task = F.when(n % 3 == 0, "spatial_cluster").when(n % 3 == 1, "cross_slice_generalization").otherwise("supervised_low_label")
    s = spots(spark, sf).select("obs_name", "x", "y", n.alias("n"), F.col("slice_id").alias("slice"), task.alias("task"), F.when(n % 2 == 0, "DLPFC").otherwise("Kidney").alias("cohort"), F.col("label").alias("model"), F.lit("fixed_2").alias("tag"), F.lit("pool_40x").alias("pool"))
    for rows, below in (
        (s.where("n % 3 = 0").withColumn("leaf", F.lit("synthetic")), ["slice", "leaf"]),
        (s.where("n % 3 = 1 or n % 3 = 0 and slice = 's0'").withColumns({"kind": F.lit("slices"), "leaf": F.concat(F.lit("slice_"), "slice")}), ["kind", "leaf"]),
        (s.withColumn("leaf", F.lit("synthetic_pool_40x")), ["leaf"]),
        (s.where("n % 3 = 2").withColumns({"kind": F.lit("conditions"), "condition": F.col("model"), "leaf": F.lit("synthetic")}), ["kind", "condition", "leaf"]),
    ):
        by = ["task", "cohort", "model", "tag", "pool", *below]
        rows.select("obs_name", "x", "y", *by).repartition(*by).write.mode("append").partitionBy(*by).parquet(root)
    return D.listing(spark, root, "*.parquet")


def _rel(found):
    return found.withColumn("rel", F.array_join("parts", "/"))


def _selected(spark, sf):
    return D.selected(_tree(spark, sf), D.pool_rules(["DLPFC"]), all_if_none=True)


@query("A14", f", {_TREE} SELECT pool || '|' || slice_id AS pool, rel, kind AS rule FROM tree WHERE kind = 'folder' OR kind = 'slices' AND n % 3 = 1")
def a14(spark, sf):
    return _rel(D.selected(_tree(spark, sf), D.slice_rules())).select("pool", "rel", "rule")


@query("A16", f", {_CHOSEN} SELECT pool, rel, rule FROM chosen")
def a16(spark, sf):
    return _rel(_selected(spark, sf)).select("pool", "rel", "rule")


@query("A16_rest", f", {_CHOSEN} SELECT rel FROM tree WHERE rel NOT IN (SELECT rel FROM chosen)")
def a16_rest(spark, sf):
    found = _tree(spark, sf)
    return _rel(D.not_selected(found, D.selected(found, D.pool_rules(["DLPFC"])))).select("rel")


@query("A17", f", {_CHOSEN} SELECT rel FROM chosen WHERE cohort = 'DLPFC' AND label IN ('L0', 'L2', 'L3')")
def a17(spark, sf):
    return _rel(D.of(_selected(spark, sf), "DLPFC", ["L0", "L2", "L3"])).select("rel")


@query("A18", f", {_CHOSEN} SELECT rel, CASE n % 3 WHEN 0 THEN 'spatial_cluster/' || cohort || '/model_inputs/' || label || '/unsupervised' WHEN 1 THEN 'cross_slice_generalization/' || cohort || '/model_inputs/' || label || '/fixed_2' END AS reference FROM chosen")
def a18(spark, sf):
    return _rel(_selected(spark, sf)).select("rel", D.reference_path(["DLPFC", "Kidney"], [f"L{k}" for k in range(10)]).alias("reference"))


@query("A19", f", {_TREE} SELECT rel FROM tree WHERE kind IN ('folder', 'conditions')")
def a19(spark, sf):
    return _rel(D.leaves(_tree(spark, sf))).select("rel")


@query("A35", f", {_TREE} SELECT rel, slice_id FROM tree WHERE kind = 'slices' AND label IN ('L1', 'L4', 'L6') AND slice_id IN ('s0', 's2')")
def a35(spark, sf):
    return _rel(D.slice_files(_tree(spark, sf), "fixed_2", ["L1", "L4", "L6"], ["s0", "s2"])).select("rel", "slice_id")


@query("J37", "SELECT DISTINCT concat_ws('|', model, seed::VARCHAR, slice_id, paradigm, CASE WHEN paradigm = 'global_synthetic_only' THEN 'synthetic_pool' ELSE 'real_train' END, '50') AS key FROM (SELECT model, seed, slice_id, CASE WHEN paradigm = 'global' THEN 'global_synthetic_only' ELSE paradigm END AS paradigm FROM pred)")
def j37(spark, sf):
    family = F.when(F.col("paradigm") == "global", "global_synthetic_only").otherwise(F.col("paradigm"))
    return predictions(spark, sf).select(C.feature_key(F.col("model"), F.col("seed"), F.col("slice_id"), family, 50).alias("key")).distinct()


def _norm(df):
    return F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v * v), 4).alias("norm2")


_MEAN = "mean AS (SELECT {f} AS fold, k, avg(vec[k]) AS m FROM real, (SELECT unnest(range(1, 65)) AS k), (SELECT unnest(range(0, 4)) AS fold) WHERE {w} GROUP BY ALL)"


@query("N19", f", {_MEAN.format(f='0', w='fold = 0')} SELECT obs_name, round(sum(pow(vec[k] - m, 2)), 4) AS norm2 FROM spots, mean GROUP BY obs_name")
def n19(spark, sf):
    """All components keep the length of a centred row. The second call reads what the first one kept."""
    cache = C.Cache(spark, B.scratch(spark, "cache"), "spots")
    rows, fit_on = spots(spark, sf), real(spark, sf)
    for _ in range(2):
        kept = cache.projected(rows.select("obs_name", "vec"), fit_on, "vec", 64, family="global_real_plus_synthetic")
    return kept.select("obs_name", _norm(kept))


@query("N21", f", {_MEAN.format(f='fold', w=chr(39) + 's' + chr(39) + ' || fold <> slice_id')} SELECT fold::INT AS fold, obs_name, round(sum(pow(vec[k] - m, 2)), 4) AS norm2 FROM real JOIN mean ON slice_id = 's' || fold GROUP BY ALL")
def n21(spark, sf):
    """Each slice on the components of the others."""
    cache, rows, out = C.Cache(spark, B.scratch(spark, "cache"), "spots"), real(spark, sf), None
    for fold in range(4):
        train = [f"s{k}" for k in range(4) if k != fold]
        held = cache.fold_projection(rows, fold, train, 64).transform(rows.where(F.col("slice_id") == f"s{fold}"), "vec")
        part = held.select(F.lit(fold).alias("fold"), "obs_name", _norm(held))
        out = part if out is None else out.unionByName(part)
    return out


@query("M11", _M4 + ", a AS (SELECT unnest([0.2, 0.4, 0.8]::DOUBLE[]) AS alpha) SELECT alpha, obs_name, augmentation_source, round(CASE WHEN augmentation_source = 'real' THEN 1 - alpha ELSE alpha END / count(*) OVER (PARTITION BY alpha, augmentation_source), 9) AS loss_weight FROM pkg, a")
def m11(spark, sf):
    cache, out = C.Cache(spark, B.scratch(spark, "cache"), "packages"), None
    found = cache.weighted_package(P.builder("weighted_erm"), real(spark, sf), pool(spark, sf), 1.0, [0.2, 0.4, 0.8], 42)
    for alpha, df in found.items():
        part = df.select(F.lit(alpha).alias("alpha"), "obs_name", "augmentation_source", F.round("loss_weight", 9).alias("loss_weight"))
        out = part if out is None else out.unionByName(part)
    return out


def _domains(e):
    return e.select("spot").distinct().withColumn("domain", F.concat(F.lit("D"), F.col("spot") % 5))


@query("N16")
def n16(spark, sf):
    e = expr(spark, sf)
    found = G.find_meta_gene(e, _domains(e), "D1", 7)
    return found.values.select("spot", F.round("meta", 6).alias("meta"), F.lit(found.name).alias("name"))


@query("N23")
def n23(spark, sf):
    e = expr(spark, sf)
    return G.meta_values(e, _domains(e), "D2", 11).select("spot", F.round("meta", 6).alias("meta"))
