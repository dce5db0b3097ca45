"""Queries for sampling, packages, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import contracts as C
from ..operators import paradigm as P
from ..operators import sampling as A
from ..operators import tables as T
from .registry import expr, pool, predictions, query, real, spots, table


def _rank(by: str, seed: int = 42) -> str:
    part = f"PARTITION BY {by} " if by else ""
    return f"row_number() OVER ({part}ORDER BY md5('{seed}||' || obs_name), obs_name)"


_REAL_N = "want AS (SELECT {by}, greatest(round_even(count(*) * {ratio}, 0), 1) AS want FROM real GROUP BY ALL)"
_BIN = "CASE WHEN len({e}) < 3 THEN 0 ELSE len(list_filter({e}[2:len({e}) - 1], lambda e: e <= {v})) END"
_Q = "[0, 1/3, 2/3, 1]"
_REG = f"""edges AS (SELECT slice_id, list_sort(list_distinct(quantile_cont(x, {_Q}))) AS ex, list_sort(list_distinct(quantile_cont(y, {_Q}))) AS ey FROM spots GROUP BY slice_id),
reg AS (SELECT s.*, 'r' || {_BIN.format(e='ex', v='x')} || '_' || {_BIN.format(e='ey', v='y')} AS region FROM spots s JOIN edges USING (slice_id)),
rreal AS (SELECT * FROM reg WHERE source = 'real'), rpool AS (SELECT * FROM reg WHERE source = 'synthetic')"""


def _regions(spark, sf):
    r = P.quantile_regions(spots(spark, sf), ["slice_id"])
    return r.where("source = 'real'"), r.where("source = 'synthetic'")


_F1 = f"SELECT obs_name, CASE WHEN r <= greatest(least(round_even(n * 0.5, 0), n - 1), 1) THEN 'train' ELSE 'test' END AS split FROM (SELECT obs_name, {_rank('slice_id, label')} AS r, count(*) OVER (PARTITION BY slice_id, label) AS n FROM spots)"


@query("F1", _F1)
def f1(spark, sf):
    return A.stratified_split(spots(spark, sf), ["slice_id", "label"], 0.5, 42, "obs_name").select("obs_name", "split")


@query("F2", f"SELECT obs_name FROM (SELECT obs_name, {_rank('slice_id')} AS r, count(*) OVER (PARTITION BY slice_id) AS n FROM spots) WHERE r <= greatest(round_even(n * 0.3, 0), 1)")
def f2(spark, sf):
    return A.fraction(spots(spark, sf), ["slice_id"], 0.3, 42, "obs_name").select("obs_name")


@query("F3", f"SELECT obs_name FROM (SELECT obs_name, {_rank('slice_id')} AS r FROM spots) WHERE r <= 10")
def f3(spark, sf):
    return A.head(spots(spark, sf), ["slice_id"], 10, 42, "obs_name").select("obs_name")


_F4 = f", {_REAL_N.format(by='label', ratio='0.5')} SELECT obs_name, label FROM (SELECT p.*, want, {_rank('label')} AS r FROM pool p JOIN want USING (label)) WHERE r <= want"


@query("F4", _F4)
def f4(spark, sf):
    return A.matched(real(spark, sf), pool(spark, sf), ["label"], 0.5, 42, "obs_name").select("obs_name", "label")


@query("F5", f""", {_REG}, want AS (SELECT label, region, greatest(round_even(count(*) * 0.5, 0), 1) AS want FROM rreal GROUP BY ALL),
direct AS (SELECT obs_name, label, region FROM (SELECT p.*, want, {_rank('label, region')} AS r FROM rpool p JOIN want USING (label, region)) WHERE r <= want),
lack AS (SELECT label, sum(want) AS want FROM want ANTI JOIN rpool USING (label, region) GROUP BY label),
spare AS (SELECT obs_name, label, region FROM (SELECT p.*, want, {_rank('label')} AS r FROM rpool p JOIN lack USING (label)) WHERE r <= want)
SELECT * FROM direct UNION ALL SELECT * FROM spare ANTI JOIN direct USING (obs_name)""")
def f5(spark, sf):
    r, p = _regions(spark, sf)
    return A.matched_with_fallback(r, p, "label", "region", 0.5, 42, "obs_name").select("obs_name", "label", "region")


@query("D19", f""", {_REG}, lack AS (SELECT DISTINCT label, region FROM rreal ANTI JOIN rpool USING (label, region)) SELECT label, region, count(*) AS n FROM lack JOIN (SELECT label FROM rpool) USING (label) GROUP BY ALL""")
def d19(spark, sf):
    r, p = _regions(spark, sf)
    lack = r.select("label", "region").distinct().join(p, ["label", "region"], "left_anti")
    return lack.join(p.groupBy("label").agg(F.count("*").alias("n")), "label").select("label", "region", "n")


_LEVELS = "dens AS (SELECT region, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, region) - 1 AS rank, count(*) OVER () AS R FROM rreal GROUP BY region), lev AS (SELECT region, n, rank, CASE WHEN R > 1 THEN round_even(rank * 2 / (R - 1), 0)::INT ELSE 0 END AS level, CASE WHEN R > 1 THEN rank * 0.8 / (R - 1) ELSE 0 END AS alpha FROM dens)"


@query("F6", f", {_REG}, {_LEVELS}, want AS (SELECT label, region, round_even(count(*) * (any_value(level) + 1) * 0.6 / 3, 0) AS want FROM rreal JOIN lev USING (region) GROUP BY ALL) SELECT obs_name, region FROM (SELECT p.*, want, {_rank('label, region')} AS r FROM rpool p JOIN want USING (label, region)) WHERE r <= want")
def f6(spark, sf):
    r, p = _regions(spark, sf)
    ratios = A.density_levels(r, "region", 3).select("region", ((F.col("level") + 1) * 0.6 / 3).alias("ratio"))
    return A.by_region_ratio(r, p, ratios, "label", "region", 42, "obs_name").select("obs_name", "region")


@query("F7", f", {_REG}, {_LEVELS} SELECT region, n, rank::INT AS rank, level FROM lev")
def f7(spark, sf):
    return A.density_levels(_regions(spark, sf)[0], "region", 3)


@query("F8", f", {_REG}, {_LEVELS} SELECT region, round(alpha, 6) AS alpha FROM lev")
def f8(spark, sf):
    return A.density_alphas(_regions(spark, sf)[0], "region", 0.8).select("region", F.round("alpha", 6).alias("alpha"))


@query("F9", "SELECT a.gene_idx, a.spot, b.value FROM (SELECT gene_idx, spot, row_number() OVER (PARTITION BY gene_idx ORDER BY value, spot) AS r FROM expr) a JOIN (SELECT (gene_idx + 1) % 60 AS gene_idx, value, row_number() OVER (PARTITION BY gene_idx ORDER BY value, spot) AS r FROM expr) b USING (gene_idx, r)")
def f9(spark, sf):
    e = expr(spark, sf)
    place = e.select("gene_idx", "spot", F.row_number().over(W.partitionBy("gene_idx").orderBy("value", "spot")).alias("r"))
    sim = e.select(((F.col("gene_idx") + 1) % 60).alias("gene_idx"), "value", F.row_number().over(W.partitionBy("gene_idx").orderBy("value", "spot")).alias("r"))
    return place.join(sim, ["gene_idx", "r"]).select("gene_idx", "spot", "value")


@query("F11", "SELECT n, round(corr(a, b), 6) AS corr FROM (SELECT count(*) OVER () AS n, a, b FROM (SELECT x AS a, row_number() OVER (ORDER BY x, obs_name) AS r FROM real) JOIN (SELECT x AS b, row_number() OVER (ORDER BY x, obs_name) AS r FROM pool) USING (r)) GROUP BY n")
def f11(spark, sf):
    from ..operators.metrics import safe_corr
    from ..operators.places import sorted_pairs

    both = sorted_pairs(real(spark, sf), pool(spark, sf), "x", "obs_name")
    return safe_corr(both, [], "a", "b")


_GROUPS = "top AS (SELECT g, label FROM (SELECT g, label, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, label) AS o FROM gs GROUP BY g, label) WHERE o = 1), rk AS (SELECT g, label, row_number() OVER (PARTITION BY label ORDER BY md5('42||' || g), g) AS r, count(*) OVER (PARTITION BY label) AS n FROM top)"
_GS = "gs AS (SELECT obs_name, 'g' || (pos % 40) AS g, 'L' || (pos % 40 % 3) AS label FROM spots)"


def _gs(spark, sf):
    m = F.col("pos") % 40
    return spots(spark, sf).select("obs_name", F.concat(F.lit("g"), m).alias("g"), F.concat(F.lit("L"), m % 3).alias("label"))


@query("F12", f", {_GS}, {_GROUPS}, t AS (SELECT g, CASE WHEN r <= greatest(floor(n * 0.6), 1) THEN 'train' WHEN r <= greatest(floor(n * 0.6), 1) + CASE WHEN n > 2 THEN greatest(floor(n * 0.2), 1) ELSE 0 END THEN 'val' ELSE 'test' END AS split FROM rk) SELECT obs_name, split FROM gs JOIN t USING (g)")
def f12(spark, sf):
    return A.group_split(_gs(spark, sf), "g", "label", (0.6, 0.2), 42).select("obs_name", "split")


@query("F13", f"SELECT obs_name, CASE WHEN r <= greatest(floor(n * 0.7), 1) THEN 'train' ELSE 'test' END AS split FROM (SELECT obs_name, {_rank('label')} AS r, count(*) OVER (PARTITION BY label) AS n FROM spots)")
def f13(spark, sf):
    s = spots(spark, sf)
    n = F.count("*").over(W.partitionBy("label"))
    r = F.row_number().over(W.partitionBy("label").orderBy(S.hash_order(42, F.col("obs_name")), "obs_name"))
    return s.select("obs_name", F.when(r <= F.greatest(F.floor(n * 0.7), F.lit(1)), "train").otherwise("test").alias("split"))


@query("F14", f", {_GS}, {_GROUPS} SELECT obs_name, ((r - 1) % 5)::INT AS fold FROM gs JOIN rk USING (g)")
def f14(spark, sf):
    return A.group_folds(_gs(spark, sf), "g", "label", 5, 42).select("obs_name", "fold")


@query("F15", f"SELECT obs_name FROM (SELECT obs_name, {_rank('label')} AS r FROM spots WHERE label IN ('L0', 'L1')) WHERE r <= 8")
def f15(spark, sf):
    return A.balanced_head(spots(spark, sf).where("label in ('L0', 'L1')"), "label", 15, 42, "obs_name").select("obs_name")


@query("F16", "SELECT obs_name, 'all' AS split FROM spots")
def f16(spark, sf):
    return spots(spark, sf).select("obs_name", F.lit("all").alias("split"))


@query("F18", "SELECT obs_name, 'real' AS side FROM (SELECT * FROM real ORDER BY md5('42||' || obs_name), obs_name LIMIT 50) UNION ALL SELECT obs_name, 'synthetic' FROM (SELECT * FROM pool ORDER BY md5('1039||' || obs_name), obs_name LIMIT 50)")
def f18(spark, sf):
    a, b = A.sample(real(spark, sf), 50, 42, "obs_name"), A.sample(pool(spark, sf), 50, 1039, "obs_name")
    return a.select("obs_name", F.lit("real").alias("side")).unionByName(b.select("obs_name", F.lit("synthetic").alias("side")))


@query("J11", f", {_REG} SELECT obs_name, region FROM reg")
def j11(spark, sf):
    r, p = _regions(spark, sf)
    return r.unionByName(p).select("obs_name", "region")


_CELL = "least(greatest(floor(({c} - min({c}) OVER w) / greatest(max({c}) OVER w - min({c}) OVER w, 1e-9) * 4), 0), 3)::INT"
_GRID = f"SELECT obs_name, 'slice_' || slice_id || '_grid_' || {_CELL.format(c='x')} || '_' || {_CELL.format(c='y')} AS region FROM spots WINDOW w AS (PARTITION BY slice_id)"


@query("J12", _GRID)
def j12(spark, sf):
    return P.grid_regions(spots(spark, sf), "slice_id", 4).select("obs_name", "region")


@query("J13", "SELECT obs_name, CASE WHEN pos % 3 = 0 THEN 'g' || (pos % 4) WHEN pos % 3 = 1 THEN label ELSE 'all' END AS region_id FROM spots")
def j13(spark, sf):
    k = F.col("pos") % 3
    s = P.region_policy(spots(spark, sf), F.when(k == 0, F.concat(F.lit("g"), F.col("pos") % 4)), F.when(k == 1, F.col("label")))
    return s.select("obs_name", "region_id")


_M4 = f", {_REAL_N.format(by='label', ratio='1')}, syn AS (SELECT * FROM (SELECT p.*, want, {_rank('label')} AS r FROM pool p JOIN want USING (label)) WHERE r <= want), pkg AS (SELECT obs_name, label, slice_id, 'real' AS augmentation_source FROM real UNION ALL SELECT obs_name, label, slice_id, 'synthetic' FROM syn)"


@query("M1", "SELECT obs_name, 'real' AS augmentation_source, 1.0::DOUBLE AS loss_weight FROM real")
def m1(spark, sf):
    return P.builder("real_baseline")(real(spark, sf)).select("obs_name", "augmentation_source", "loss_weight")


@query("M2", _M4 + " SELECT obs_name, augmentation_source, 1.0::DOUBLE AS loss_weight FROM pkg")
def m2(spark, sf):
    return P.builder("real_synthetic")(real(spark, sf), pool(spark, sf), 1.0, seed=42).select("obs_name", "augmentation_source", "loss_weight")


@query("M3", _M4 + " SELECT obs_name, augmentation_source FROM pkg WHERE augmentation_source = 'synthetic'")
def m3(spark, sf):
    return P.builder("synthetic_only")(real(spark, sf), pool(spark, sf), 1.0, seed=42).select("obs_name", "augmentation_source")


@query("M4", _M4 + " SELECT obs_name, augmentation_source, round(CASE WHEN augmentation_source = 'real' THEN 0.6 ELSE 0.4 END / count(*) OVER (PARTITION BY augmentation_source), 9) AS loss_weight FROM pkg")
def m4(spark, sf):
    return P.builder("weighted_erm")(real(spark, sf), pool(spark, sf), 1.0, 0.4, 42).select("obs_name", "augmentation_source", F.round("loss_weight", 9).alias("loss_weight"))


@query("M5", f", {_REG}, {_LEVELS}, want AS (SELECT label, region, round_even(count(*) * (any_value(level) + 1) * 0.6 / 3, 0) AS want FROM rreal JOIN lev USING (region) GROUP BY ALL) SELECT obs_name, 'synthetic' AS augmentation_source FROM (SELECT p.*, want, {_rank('label, region')} AS r FROM rpool p JOIN want USING (label, region)) WHERE r <= want UNION ALL SELECT obs_name, 'real' FROM rreal")
def m5(spark, sf):
    r, p = _regions(spark, sf)
    return P.builder("local_spatial")(r, p, 0.6, seed=42).select("obs_name", "augmentation_source")


@query("M6", f", {_REG}, {_LEVELS}, {_REAL_N.format(by='label', ratio='1').replace('FROM real', 'FROM rreal')}, syn AS (SELECT * FROM (SELECT p.*, want, {_rank('label')} AS r FROM rpool p JOIN want USING (label)) WHERE r <= want) SELECT obs_name, 1.0::DOUBLE AS loss_weight FROM rreal UNION ALL SELECT obs_name, round(coalesce(alpha, 0), 6) FROM syn LEFT JOIN lev USING (region)")
def m6(spark, sf):
    r, p = _regions(spark, sf)
    return P.builder("regional_weighted_erm")(r, p, 1.0, 0.8, 42).select("obs_name", F.round("loss_weight", 6).alias("loss_weight"))


@query("M9", f"SELECT obs_name, slice_id FROM (SELECT obs_name, slice_id, {_rank('slice_id', 7)} AS r FROM pool) WHERE r <= 12")
def m9(spark, sf):
    return A.head(pool(spark, sf), ["slice_id"], 12, 7, "obs_name").select("obs_name", "slice_id")


_D18 = f", {_REAL_N.format(by='slice_id, label', ratio='0.5')} SELECT obs_name FROM (SELECT p.*, want, {_rank('slice_id, label')} AS r FROM pool p JOIN want USING (slice_id, label)) WHERE r <= want"


@query("D18", _D18)
def d18(spark, sf):
    return A.matched(real(spark, sf), pool(spark, sf), ["slice_id", "label"], 0.5, 42, "obs_name").select("obs_name")


@query("M7", f"{_D18} UNION ALL SELECT obs_name FROM real")
def m7(spark, sf):
    r = real(spark, sf)
    return P.union_tagged(r, A.matched(r, pool(spark, sf), ["slice_id", "label"], 0.5, 42, "obs_name")).select("obs_name")


@query("M8", f", {_REAL_N.format(by='label', ratio='1')}, k AS (SELECT unnest([0.5, 1.0, 2.0]::DOUBLE[]) AS ratio), w AS (SELECT label, ratio, greatest(round_even(n * ratio, 0), 1) AS want FROM (SELECT label, count(*) AS n FROM real GROUP BY label), k) SELECT ratio, count(*) AS n FROM (SELECT obs_name, label, {_rank('label')} AS r FROM pool) JOIN w USING (label) WHERE r <= w.want GROUP BY ratio")
def m8(spark, sf):
    """All ratios of a suite from one ranking of the pool: a larger package contains the smaller ones."""
    ratios = spark.createDataFrame([(r,) for r in (0.5, 1.0, 2.0)], "ratio double")
    want = real(spark, sf).groupBy("label").count().crossJoin(ratios).select("label", "ratio", F.greatest(F.bround(F.col("count") * F.col("ratio")), F.lit(1)).alias("want"))
    ranked = pool(spark, sf).withColumn("r", F.row_number().over(W.partitionBy("label").orderBy(S.hash_order(42, F.col("obs_name")), "obs_name")))
    return ranked.join(want, "label").where("r <= want").groupBy("ratio").agg(F.count("*").alias("n"))


_W = "round(CASE WHEN source = 'real' THEN {0} ELSE {1} END / count(*) OVER (PARTITION BY slice_id, source), 9)"


@query("J16", f"SELECT obs_name, {_W.format('0.6', '0.4')} AS w FROM spots")
def j16(spark, sf):
    return P.weights(spots(spark, sf).withColumnRenamed("source", "augmentation_source"), ["slice_id"], 0.4).select("obs_name", F.round("loss_weight", 9).alias("w"))


@query("J17", f"SELECT obs_name, {_W.format('0.4', '0.6')} AS w FROM spots")
def j17(spark, sf):
    return P.weights(spots(spark, sf).withColumnRenamed("source", "augmentation_source"), ["slice_id"], 0.4, synthetic_share=False).select("obs_name", F.round("loss_weight", 9).alias("w"))


@query("J18", "SELECT obs_name, CASE WHEN source = 'real' THEN 1.0 ELSE CASE label WHEN 'L0' THEN 0.25 WHEN 'L1' THEN 0.5 ELSE 0 END END::DOUBLE AS w FROM spots")
def j18(spark, sf):
    alphas = spark.createDataFrame([("L0", 0.25), ("L1", 0.5)], "label string, alpha double")
    return P.regional_weights(spots(spark, sf).withColumnRenamed("source", "augmentation_source"), alphas, "label").select("obs_name", F.col("loss_weight").alias("w"))


# Filters and checks

_C1 = "g AS (SELECT gene_idx FROM expr WHERE value > 40 GROUP BY 1 HAVING count(DISTINCT spot) >= 100), k AS (SELECT spot, gene_idx, value - 40 AS value FROM expr SEMI JOIN g USING (gene_idx)), s AS (SELECT spot FROM k WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT gene_idx) >= 12)"


@query("C1", f", {_C1} SELECT spot, gene_idx, value FROM k SEMI JOIN s USING (spot)")
def c1(spark, sf):
    return C.quality_filter(expr(spark, sf).withColumn("value", F.col("value") - 40), 100, 12).select("spot", "gene_idx", "value")


@query("C2", "SELECT DISTINCT l_suppkey FROM lineitem SEMI JOIN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING var_pop(l_quantity::DOUBLE) > 1e-8) USING (l_suppkey)")
def c2(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_quantity").cast("double").alias("value"))
    return C.varying_genes(li, "l_suppkey").select("l_suppkey").distinct()


@query("C3", "SELECT spot FROM expr GROUP BY spot HAVING sum(value) BETWEEN 3000 AND 4500 AND count(DISTINCT gene_idx) FILTER (value > 0) BETWEEN 10 AND 58")
def c3(spark, sf):
    return C.ranged(expr(spark, sf), "spot", "value", "gene_idx", (3000, 4500), (10, 58)).select("spot").distinct()


@query("C4", "SELECT gene_idx FROM expr GROUP BY gene_idx HAVING sum(value) BETWEEN 20000 AND 26000 AND count(DISTINCT spot) FILTER (value > 0) BETWEEN 10 AND 390")
def c4(spark, sf):
    return C.ranged(expr(spark, sf), "gene_idx", "value", "spot", (20000, 26000), (10, 390)).select("gene_idx").distinct()


@query("C5", "SELECT p_partkey FROM part WHERE NOT (starts_with(p_type, 'PROMO') OR starts_with(p_type, 'SMALL'))")
def c5(spark, sf):
    return C.without_prefixes(table(spark, sf, "part"), "p_type", ("PROMO", "SMALL")).select("p_partkey")


@query("C6", "SELECT doc_id FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'nan' WHEN 2 THEN 'unknown' ELSE lang END AS label FROM documents) WHERE label IS NOT NULL AND label NOT IN ('', 'nan', 'NaN', 'unknown')")
def c6(spark, sf):
    k = F.col("doc_id") % 5
    return C.labelled(table(spark, sf, "documents").select("doc_id", F.when(k == 0, F.lit(None)).when(k == 1, "nan").when(k == 2, "unknown").otherwise(F.col("lang")).alias("label"))).select("doc_id")


@query("C7", f"SELECT obs_name FROM ({_F1}) WHERE split = 'train'")
def c7(spark, sf):
    return C.training_rows(A.stratified_split(spots(spark, sf), ["slice_id", "label"], 0.5, 42, "obs_name")).select("obs_name")


@query("C8", f"SELECT obs_name FROM ({_F1}) JOIN spots USING (obs_name) WHERE split = 'train' AND slice_id = 's1' AND label IN ('L1', 'L2')")
def c8(spark, sf):
    rows = C.training_rows(A.stratified_split(spots(spark, sf), ["slice_id", "label"], 0.5, 42, "obs_name"))
    return rows.where("slice_id = 's1' and label in ('L1', 'L2')").select("obs_name")


@query("C9", "SELECT obs_name FROM real WHERE slice_id = 's2'")
def c9(spark, sf):
    return real(spark, sf).where("slice_id = 's2'").select("obs_name")


@query("C10", "SELECT obs_name FROM real WHERE slice_id = 's2' AND label = 'L3'")
def c10(spark, sf):
    return real(spark, sf).where("slice_id = 's2' and label = 'L3'").select("obs_name")


@query("C12", "SELECT unnest(['no_name', 'no_slice', 'bad_x', 'bad_y', 'zero_coords']) AS rule, unnest([count(*) FILTER (obs_name = ''), count(*) FILTER (slice_id IS NULL), count(*) FILTER (x IS NULL), count(*) FILTER (pos % 9 = 0), 0]) AS n FROM spots")
def c12(spark, sf):
    return C.violations(spots(spark, sf).withColumn("y", F.when(F.col("pos") % 9 != 0, F.col("y"))), {**C.spot_rules(), "zero_coords": F.lit(False)})


@query("C13", "SELECT unnest(['no_source', 'not_synthetic', 'bad_strategy']) AS rule, unnest([0, count(*) FILTER (source = 'real'), count(*) FILTER (pos % 4 = 0)]) AS n FROM spots")
def c13(spark, sf):
    s = spots(spark, sf).withColumn("strategy", F.when(F.col("pos") % 4 == 0, "other").otherwise("label_wise_generation"))
    return C.violations(s, {"no_source": F.col("source").isNull(), "not_synthetic": F.col("source") != "synthetic", "bad_strategy": ~F.col("strategy").isin("label_wise_generation", "conditional_generation")})


@query("C15", "SELECT unnest(['wrong_slice', 'no_label']) AS rule, unnest([count(*) FILTER (slice_id <> 's1'), 0]) AS n FROM pool")
def c15(spark, sf):
    return C.violations(pool(spark, sf), {"wrong_slice": F.col("slice_id") != "s1", "no_label": F.col("label").isNull()})


@query("C16", "SELECT p_partkey FROM part WHERE upper(p_type) LIKE '%PROMO%' OR (upper(p_type) LIKE '%S%' AND p_size < 10)")
def c16(spark, sf):
    t = F.upper("p_type")
    return table(spark, sf, "part").where(t.contains("PROMO") | (t.contains("S") & (F.col("p_size") < 10))).select("p_partkey")


@query("C20", "SELECT DISTINCT slice_id FROM real WHERE label = 'L1' INTERSECT SELECT slice_id FROM pool WHERE label = 'L2'")
def c20(spark, sf):
    return C.disjoint(real(spark, sf).where("label = 'L1'"), pool(spark, sf).where("label = 'L2'"), "slice_id")


@query("C21", "SELECT DISTINCT slice_id FROM pool WHERE slice_id = 's0'")
def c21(spark, sf):
    return C.one_value(pool(spark, sf).where("slice_id = 's0'"), "slice_id").select("slice_id").distinct()


@query("C27", "SELECT slice_id, label, count(*) AS n FROM pool WHERE slice_id = 's1' GROUP BY ALL")
def c27(spark, sf):
    return C.some_rows(pool(spark, sf).where("slice_id = 's1'"), "local").groupBy("slice_id", "label").agg(F.count("*").alias("n"))


@query("C23", "SELECT obs_name, label FROM spots WHERE slice_id = 's3'")
def c23(spark, sf):
    return spots(spark, sf).where("slice_id = 's3'").select("obs_name", "label")


@query("C24", "SELECT DISTINCT slice_id FROM real")
def c24(spark, sf):
    return real(spark, sf).select("slice_id").distinct().orderBy("slice_id")


@query("C26", "SELECT n_nationkey::BIGINT AS at, n_name AS \"left\", CASE WHEN n_nationkey % 6 = 0 THEN lower(n_name) ELSE n_name END AS \"right\" FROM nation WHERE n_nationkey % 6 = 0 AND lower(n_name) <> n_name")
def c26(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("at"), F.col("n_name").alias("gene"))
    return C.same_order(n, n.withColumn("gene", F.when(F.col("at") % 6 == 0, F.lower("gene")).otherwise(F.col("gene"))), "at", "gene")


# Projections and sets


@query("B1", "SELECT spot, gene_idx, value FROM expr WHERE gene_idx % 3 = 0")
def b1(spark, sf):
    e = expr(spark, sf)
    genes = e.select("gene_idx").distinct().withColumn("highly_variable", F.col("gene_idx") % 3 == 0)
    return T.selected_genes(e, genes).select("spot", "gene_idx", "value")


_B2 = "SELECT a.n_name AS gene, a.n_nationkey::BIGINT AS old_a, (25 - a.n_nationkey)::BIGINT AS old_b, (row_number() OVER (ORDER BY a.n_nationkey) - 1)::INT AS gene_idx FROM nation a WHERE n_nationkey % 2 = 0"


@query("B2", _B2)
def b2(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_name").alias("gene"), F.col("n_nationkey").cast("long").alias("gene_idx"))
    return T.aligned_genes(n, n.where("gene_idx % 2 = 0").withColumn("gene_idx", 25 - F.col("gene_idx")))


@query("B3", _B2)
def b3(spark, sf):
    return b2(spark, sf)


@query("B4", "SELECT obs_name, slice_id, x, y FROM spots")
def b4(spark, sf):
    return C.forbid_labels(spots(spark, sf).select("obs_name", "slice_id", "x", "y"), "unsupervised")


@query("B7", "SELECT obs_name, label, NULL::BIGINT AS pos FROM real UNION ALL SELECT obs_name, NULL, pos FROM pool")
def b7(spark, sf):
    return P.union_tagged(real(spark, sf).select("obs_name", "label"), pool(spark, sf).select("obs_name", "pos"), outer=True).select("obs_name", "label", "pos")


@query("B8", "SELECT doc_id, coalesce(CASE WHEN doc_id % 4 > 0 THEN lang END, '') AS lang, source FROM documents")
def b8(spark, sf):
    return T.text_columns(table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 4 > 0, F.col("lang")).alias("lang"), "source"))


_B9 = "ref AS (SELECT *, row_number() OVER (PARTITION BY slice_id, label ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY slice_id, label) AS n FROM real), syn AS (SELECT slice_id, label, i, any_value(n) AS n FROM ref, (SELECT unnest(range(7)) AS i) GROUP BY ALL)"


@query("B9", f", {_B9} SELECT 'sim_' || s.slice_id || '_' || s.label || '_' || i AS synthetic_id, obs_name AS source_obs_name FROM syn s JOIN ref r ON r.slice_id = s.slice_id AND r.label = s.label AND r.k = i % s.n")
def b9(spark, sf):
    r = real(spark, sf)
    counts = r.select("slice_id", "label").distinct().withColumn("n", F.lit(7))
    return T.synthetic_rows(r, counts, "sim", ["slice_id", "label"], "pos").select("synthetic_id", "source_obs_name")


@query("B10", f", {_B9} SELECT s.slice_id, s.label, i, x, y FROM syn s JOIN ref r ON r.slice_id = s.slice_id AND r.label = s.label AND r.k = i % s.n")
def b10(spark, sf):
    r = real(spark, sf)
    counts = r.select("slice_id", "label").distinct().withColumn("n", F.lit(7))
    return T.synthetic_rows(r, counts, "sim", ["slice_id", "label"], "pos").select("slice_id", "label", "i", "x", "y")


@query("B11", "SELECT obs_name, 'synthetic' AS augmentation_source, 'sim' AS generator, slice_id AS sample_id FROM pool")
def b11(spark, sf):
    return pool(spark, sf).select("obs_name", F.lit("synthetic").alias("augmentation_source"), F.lit("sim").alias("generator"), F.col("slice_id").alias("sample_id"))


@query("B12", "SELECT slice_id, count(*) AS n_train, 'pool_40x' AS pool_name, count(*) * 40 AS n_target FROM real GROUP BY slice_id")
def b12(spark, sf):
    return real(spark, sf).groupBy("slice_id").agg(F.count("*").alias("n_train")).select("slice_id", "n_train", S.pool_tag(F.lit(40)).alias("pool_name"), (F.col("n_train") * 40).alias("n_target"))


@query("B13", "SELECT obs_name, x FROM real")
def b13(spark, sf):
    return T.reindexed(spots(spark, sf).select("obs_name", "x"), real(spark, sf).select("obs_name"), "obs_name")


@query("B14", "SELECT obs_name AS barcode, pos AS patch_idx, x FROM real")
def b14(spark, sf):
    s = spots(spark, sf)
    raw = s.select(F.when(F.col("pos") % 4 == 0, F.concat_ws(":", "slice_id", "obs_name")).otherwise(F.col("obs_name")).alias("obs_name"), "slice_id", "x")
    return T.matched_barcodes(raw, real(spark, sf).select("obs_name", F.col("pos").alias("patch_idx")), "obs_name", F.col("slice_id")).select("barcode", "patch_idx", "x")


@query("B15", _M4 + " SELECT p.obs_name, augmentation_source, round(vec[3], 6) AS f FROM pkg p JOIN spots USING (obs_name)")
def b15(spark, sf):
    package = P.builder("real_synthetic")(real(spark, sf), pool(spark, sf), 1.0, seed=42).select("obs_name", "augmentation_source")
    return package.join(spots(spark, sf).select("obs_name", F.round(F.col("vec")[2], 6).alias("f")), "obs_name")


_PATH = "'out/' || model || '/fam' || seed || '/v_syn' || coalesce(ratio::INT::VARCHAR, '0') || 'p5_x/clusters.csv'"


@query("B16", "SELECT obs_name, model, 'fam' || seed AS family, 'v_syn' || coalesce(ratio::INT::VARCHAR, '0') || 'p5_x' AS variant, coalesce(ratio, 0) + 0.5 AS synthetic_ratio FROM pred")
def b16(spark, sf):
    p = predictions(spark, sf)
    path = F.concat(F.lit("out/"), "model", F.lit("/fam"), "seed", F.lit("/v_syn"), F.coalesce(F.col("ratio").cast("int").cast("string"), F.lit("0")), F.lit("p5_x/clusters.csv"))
    return p.select("obs_name", *(c.alias(k) for k, c in T.path_context(path).items()))


@query("B17", "SELECT obs_name, model, slice_id FROM pred")
def b17(spark, sf):
    path = F.concat(F.lit("pool/"), "model", F.lit("/slices/slice_"), "slice_id", F.lit(".parquet"))
    return predictions(spark, sf).select("obs_name", F.regexp_extract(path, r"^pool/([^/]+)/", 1).alias("model"), F.regexp_extract(path, r"slice_([^/]+)\.parquet$", 1).alias("slice_id"))


@query("B18", "SELECT obs_name, len(vec) + 2 AS width, round(x + list_sum(vec), 6) AS total FROM spots")
def b18(spark, sf):
    s = spots(spark, sf).withColumn("fused", F.concat(F.array("x", F.lit(0.0)), "vec"))
    return s.select("obs_name", F.size("fused").cast("long").alias("width"), F.round(F.aggregate("fused", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


@query("B19", "SELECT pos, slice_id || '_' || label || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY slice_id, label ORDER BY pos) - 1 AS k FROM spots)")
def b19(spark, sf):
    return T.unique_names(spots(spark, sf).select("pos", F.concat_ws("_", "slice_id", "label").alias("name")), "name", ["pos"])


@query("H1", "SELECT obs_name, source, 'real' AS augmentation_source FROM real UNION ALL SELECT obs_name, source, 'synthetic' FROM pool")
def h1(spark, sf):
    return P.union_tagged(real(spark, sf).select("obs_name", "source", "label"), pool(spark, sf).select("obs_name", "source", "x"))


@query("H2", "SELECT obs_name, label, NULL::DOUBLE AS x, 'real' AS augmentation_source FROM real UNION ALL SELECT obs_name, NULL, x, 'synthetic' FROM pool")
def h2(spark, sf):
    return P.union_tagged(real(spark, sf).select("obs_name", "label"), pool(spark, sf).select("obs_name", "x"), outer=True)


@query("H3", "SELECT slice_id, count(*) AS n FROM spots GROUP BY slice_id")
def h3(spark, sf):
    s = spots(spark, sf)
    parts = [s.where(F.col("slice_id") == f"s{k}") for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.groupBy("slice_id").agg(F.count("*").alias("n"))


@query("H5", "SELECT obs_name, CASE WHEN pos % 2 = 0 THEN 0.5 ELSE 1.0 END::DOUBLE AS loss_weight FROM spots")
def h5(spark, sf):
    both = real(spark, sf).select("obs_name", F.lit(0.5).alias("loss_weight")).unionByName(pool(spark, sf).select("obs_name"), allowMissingColumns=True)
    return both.withColumn("loss_weight", F.coalesce("loss_weight", F.lit(1.0)))


@query("H6", "SELECT gene_idx FROM expr WHERE spot < 50 INTERSECT SELECT gene_idx FROM expr WHERE spot > 350")
def h6(spark, sf):
    e = expr(spark, sf)
    return e.where("spot < 50").select("gene_idx").intersect(e.where("spot > 350").select("gene_idx"))


@query("H7", f", {_REAL_N.format(by='label', ratio='0.5')} SELECT obs_name FROM pool ANTI JOIN (SELECT obs_name FROM (SELECT p.*, want, {_rank('label')} AS r FROM pool p JOIN want USING (label)) WHERE r <= want) USING (obs_name)")
def h7(spark, sf):
    taken = A.matched(real(spark, sf), pool(spark, sf), ["label"], 0.5, 42, "obs_name")
    return pool(spark, sf).join(taken.select("obs_name"), "obs_name", "left_anti").select("obs_name")


@query("H8", "SELECT pos, label || CASE WHEN k > 0 THEN '-' || k ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY pos) - 1 AS k FROM spots)")
def h8(spark, sf):
    return T.unique_names(spots(spark, sf).select("pos", F.col("label").alias("name")), "name", ["pos"])


@query("E33", "SELECT slice_id, label FROM (SELECT slice_id, label, row_number() OVER (PARTITION BY slice_id ORDER BY n DESC, label) AS r FROM (SELECT slice_id, label, count(*) AS n FROM spots GROUP BY slice_id, label)) WHERE r = 1")
def e33(spark, sf):
    from ..operators.ranking import top_k

    counts = spots(spark, sf).groupBy("slice_id", "label").count()
    return top_k(counts, ["slice_id"], [F.desc("count"), F.col("label")]).select("slice_id", "label")


@query("E34", f"SELECT split, slice_id, label, count(*) AS n FROM ({_F1}) JOIN spots USING (obs_name) GROUP BY ALL")
def e34(spark, sf):
    return A.stratified_split(spots(spark, sf), ["slice_id", "label"], 0.5, 42, "obs_name").groupBy("split", "slice_id", "label").agg(F.count("*").alias("n"))


@query("E35", "SELECT gene_idx FROM expr GROUP BY gene_idx HAVING count(DISTINCT spot % 20) = 20")
def e35(spark, sf):
    return C.common_genes(expr(spark, sf).withColumn("sample", F.col("spot") % 20), "sample", "gene_idx")


@query("D5", "SELECT p.obs_name, p.y_pred, e.event_type AS truth FROM pred p JOIN events e ON p.obs_name = 'o' || e.event_id WHERE p.paradigm = 'global'")
def d5(spark, sf):
    truth = table(spark, sf, "events").select(F.concat(F.lit("o"), F.col("event_id")).alias("obs_name"), F.col("event_type").alias("truth"))
    return predictions(spark, sf).where("paradigm = 'global'").select("obs_name", "y_pred").join(truth, "obs_name")


@query("D6", "SELECT s.obs_name, r.x, r.y FROM (SELECT obs_name, CASE WHEN source = 'synthetic' THEN 'spot' || (pos - 1) ELSE obs_name END AS k FROM spots) s LEFT JOIN real r ON r.obs_name = s.k")
def d6(spark, sf):
    s = spots(spark, sf).select("obs_name", F.when(F.col("source") == "synthetic", F.concat(F.lit("spot"), F.col("pos") - 1)).otherwise(F.col("obs_name")).alias("k"))
    return s.join(real(spark, sf).select(F.col("obs_name").alias("k"), "x", "y"), "k", "left").select("obs_name", "x", "y")


@query("D7", "SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def d7(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")


@query("D21", "SELECT o_custkey % 5 AS fold, c_mktsegment, v.f AS package, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest(['a', 'b']) AS f) v GROUP BY ALL")
def d21(spark, sf):
    packages = spark.createDataFrame([("a",), ("b",)], "package string")
    samples = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counted = samples.groupBy((F.col("o_custkey") % 5).alias("fold"), "c_mktsegment").agg(F.count("*").alias("n"))
    return counted.crossJoin(packages)


@query("A26", f"SELECT split, count(*) AS n_spots, list_sort(list_distinct(list(slice_id))) AS slices FROM ({_F1}) JOIN spots USING (obs_name) GROUP BY split")
def a26(spark, sf):
    return A.stratified_split(spots(spark, sf), ["slice_id", "label"], 0.5, 42, "obs_name").groupBy("split").agg(F.count("*").alias("n_spots"), F.array_sort(F.collect_set("slice_id")).alias("slices"))


@query("A7", "SELECT 'smp' || (l_suppkey % 7) || ':' || l_orderkey || '-' || l_linenumber AS id, n_name FROM lineitem JOIN nation ON n_nationkey = l_suppkey % 7 WHERE l_returnflag IN ('A', 'R')")
def a7(spark, sf):
    li = table(spark, sf, "lineitem").where(F.upper("l_returnflag").isin("A", "R"))
    meta = table(spark, sf, "nation").select("n_nationkey", "n_name")
    k = F.col("l_suppkey") % 7
    return li.join(meta, F.col("n_nationkey") == k).select(F.concat_ws(":", F.concat(F.lit("smp"), k), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("id"), "n_name")


@query("A12", "SELECT obs_name, slice_id, x, y FROM real")
def a12(spark, sf):
    return real(spark, sf).select("obs_name", "slice_id", "x", "y")


@query("A15", "SELECT obs_name FROM pool WHERE slice_id = 's0'")
def a15(spark, sf):
    return pool(spark, sf).where("slice_id = 's0'").select("obs_name")


@query("A34", "SELECT obs_name, pos AS patch, round(list_sum(vec), 6) AS s FROM real")
def a34(spark, sf):
    total = F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v), 6).alias("s")
    return T.matched_barcodes(spots(spark, sf).select("obs_name", "slice_id", total), real(spark, sf).select("obs_name", F.col("pos").alias("patch_idx")), "obs_name", F.col("slice_id")).select(F.col("barcode").alias("obs_name"), F.col("patch_idx").alias("patch"), "s")
