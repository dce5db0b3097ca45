"""Queries for metrics, summaries, rankings and reshaping."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import ranking as R
from .registry import expr, pool, predictions, query, real, spots, table

#: Counted rows per group g and label: support, predicted, tp.
_PER = """per AS (SELECT {g}, label, sum(s)::DOUBLE AS support, sum(p)::DOUBLE AS predicted, sum(t)::DOUBLE AS tp FROM (
  SELECT {g}, y_true AS label, count(*) AS s, 0 AS p, sum((y_true = y_pred)::INT) AS t FROM pred GROUP BY ALL
  UNION ALL SELECT {g}, y_pred, 0, count(*), 0 FROM pred GROUP BY ALL) GROUP BY ALL)"""
_CLS = """cls AS (SELECT {g}, sum(support) AS n, round(sum(tp) / sum(support), {d}) AS accuracy, round(avg(CASE WHEN support > 0 THEN tp / support END), {d}) AS balanced_accuracy,
  round(avg(coalesce(2 * tp / nullif(support + predicted, 0), 0)), {d}) AS macro_f1, round(sum(support * coalesce(2 * tp / nullif(support + predicted, 0), 0)) / sum(support), {d}) AS weighted_f1,
  round((sum(tp) * sum(support) - sum(support * predicted)) / sqrt((pow(sum(support), 2) - sum(predicted * predicted)) * (pow(sum(support), 2) - sum(support * support))), {d}) AS mcc FROM per GROUP BY ALL)"""
_KEYS = "model, paradigm, ratio, alpha, classifier, slice_id, seed"


def _summary(spark, sf):
    return M.classification(predictions(spark, sf), ["model", "paradigm", "ratio", "alpha", "classifier", "slice_id", "seed"], places=12)


def _summary_sql(select: str) -> str:
    return f", {_PER.format(g=_KEYS)}, {_CLS.format(g=_KEYS, d=12)} {select}"


q = query


@q("E1", f", {_PER.format(g='model, slice_id')}, {_CLS.format(g='model, slice_id', d=6)} SELECT model, slice_id, n::BIGINT AS n, accuracy, balanced_accuracy, macro_f1, weighted_f1, mcc FROM cls")
def e1(spark, sf):
    return M.classification(predictions(spark, sf), ["model", "slice_id"])


@q("E2", f", {_PER.format(g='model, slice_id')} SELECT model, slice_id, label, support::BIGINT AS support, round(coalesce(tp / nullif(predicted, 0), 0), 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (support + predicted), 6) AS f1 FROM per WHERE support > 0")
def e2(spark, sf):
    return M.per_label(predictions(spark, sf), ["model", "slice_id"])


@q("E3", """, sc AS (SELECT model, (y_true = 'L0')::INT AS t, score AS s FROM pred),
rk AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / 2 AS r, sum(t) OVER (PARTITION BY model ORDER BY s DESC) AS tp, count(*) OVER (PARTITION BY model ORDER BY s DESC) AS k FROM sc)
SELECT model, count(*) AS n, round((sum(r * t) - sum(t) * (sum(t) + 1) / 2) / (sum(t) * sum(1 - t)), 6) AS auroc, round(sum(t * tp / k) / sum(t), 6) AS auprc, round(sum(CASE WHEN s >= 0.5 THEN t ELSE 0 END) / sum(t), 6) AS sensitivity, round(sum(CASE WHEN s < 0.5 THEN 1 - t ELSE 0 END) / sum(1 - t), 6) AS specificity FROM rk GROUP BY model""")
def e3(spark, sf):
    return M.ranking(predictions(spark, sf), ["model"], F.col("y_true") == "L0", F.col("score"))


@q("E4", "SELECT model, ratio, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL")
def e4(spark, sf):
    return M.confusion(predictions(spark, sf), ["model", "ratio"])


_STATS = ", ".join(f"round({f}, 6) AS {m}_{k}" for m in ("accuracy", "macro_f1") for k, f in (("mean", f"avg({m})"), ("std", f"stddev_samp({m})"), ("median", f"quantile_cont({m}, 0.5)"), ("max", f"max({m})"), ("min", f"min({m})")))


@q("E5", _summary_sql(f"SELECT model, paradigm, ratio, alpha, classifier, count(*) AS n, {_STATS} FROM cls GROUP BY ALL"))
def e5(spark, sf):
    return M.spread(_summary(spark, sf), ["model", "paradigm", "ratio", "alpha", "classifier"], ["accuracy", "macro_f1"])


_DELTA = "base AS (SELECT model AS m, classifier AS c, slice_id AS s, seed AS d, max(accuracy) AS ba, max(macro_f1) AS bf FROM cls WHERE paradigm = 'baseline' GROUP BY ALL), delta AS (SELECT cls.*, round(accuracy - ba, 12) AS delta_accuracy, round(macro_f1 - bf, 12) AS delta_macro_f1 FROM cls LEFT JOIN base ON model = m AND classifier = c AND slice_id = s AND seed = d)"


def _delta(spark, sf):
    return M.baseline_delta(_summary(spark, sf), F.col("paradigm") == "baseline", ["model", "classifier", "slice_id", "seed"], ["accuracy", "macro_f1"], places=12)


@q("D1", _summary_sql(f", {_DELTA} SELECT {_KEYS}, accuracy, macro_f1, delta_accuracy, delta_macro_f1 FROM delta"))
def d1(spark, sf):
    return _delta(spark, sf).select(*_KEYS.split(", "), "accuracy", "macro_f1", "delta_accuracy", "delta_macro_f1")


@q("D2", f", {_PER.format(g='paradigm, model, slice_id')}, pl AS (SELECT *, round(2 * tp / (support + predicted), 6) AS f1 FROM per WHERE support > 0) SELECT a.paradigm, a.model, a.slice_id, a.label, a.f1, round(a.f1 - b.f1, 6) AS delta_f1 FROM pl a LEFT JOIN pl b ON b.paradigm = 'baseline' AND a.model = b.model AND a.slice_id = b.slice_id AND a.label = b.label")
def d2(spark, sf):
    per = M.per_label(predictions(spark, sf), ["paradigm", "model", "slice_id"]).select("paradigm", "model", "slice_id", "label", "f1")
    return M.baseline_delta(per, F.col("paradigm") == "baseline", ["model", "slice_id", "label"], ["f1"])


@q("E6", _summary_sql(f", {_DELTA} SELECT model, paradigm, classifier, count(*) AS n, round(avg(macro_f1), 6) AS mean_f1, round(avg(delta_macro_f1), 6) AS mean_delta, round(avg(coalesce(delta_macro_f1 > 0, false)::INT), 6) AS win_rate FROM delta GROUP BY ALL"))
def e6(spark, sf):
    d = F.col("delta_macro_f1")
    return _delta(spark, sf).groupBy("model", "paradigm", "classifier").agg(F.count("*").alias("n"), F.round(F.avg("macro_f1"), 6).alias("mean_f1"), F.round(F.avg(d), 6).alias("mean_delta"), F.round(F.avg(F.coalesce(d > 0, F.lit(False)).cast("int")), 6).alias("win_rate"))


@q("E7", _summary_sql(f", {_DELTA} SELECT model, paradigm, ratio, alpha, count(DISTINCT seed) AS n_folds, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std, round(avg(delta_accuracy), 6) AS delta FROM delta GROUP BY ALL"))
def e7(spark, sf):
    return _delta(spark, sf).groupBy("model", "paradigm", "ratio", "alpha").agg(F.countDistinct("seed").alias("n_folds"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_samp("accuracy"), 6).alias("std"), F.round(F.avg("delta_accuracy"), 6).alias("delta"))


@q("E8", _summary_sql("SELECT model, ratio, alpha, count(DISTINCT slice_id) AS n_slices, round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1 FROM cls GROUP BY ALL"))
def e8(spark, sf):
    return _summary(spark, sf).groupBy("model", "ratio", "alpha").agg(F.countDistinct("slice_id").alias("n_slices"), *(F.round(F.avg(c), 6).alias(c) for c in ("accuracy", "macro_f1")))


@q("E11", """, c AS (SELECT slice_id, label AS t, 'c' || (pos % 7) AS k, count(*)::DOUBLE AS n FROM spots GROUP BY ALL), a AS (SELECT slice_id, t, sum(n) AS a FROM c GROUP BY ALL), b AS (SELECT slice_id, k, sum(n) AS b FROM c GROUP BY ALL), tot AS (SELECT slice_id, sum(n) AS N0 FROM c GROUP BY ALL),
j AS (SELECT slice_id, max(N0) AS N0, sum(n * (n - 1) / 2) AS sij, greatest(sum(n / N0 * ln(n * N0 / (a * b))), 0) AS mi FROM c JOIN a USING (slice_id, t) JOIN b USING (slice_id, k) JOIN tot USING (slice_id) GROUP BY slice_id),
sa AS (SELECT slice_id, sum(a * (a - 1) / 2) AS sa, -sum(a / N0 * ln(a / N0)) AS ha FROM a JOIN tot USING (slice_id) GROUP BY slice_id), sb AS (SELECT slice_id, sum(b * (b - 1) / 2) AS sb, -sum(b / N0 * ln(b / N0)) AS hb FROM b JOIN tot USING (slice_id) GROUP BY slice_id)
SELECT slice_id, N0::BIGINT AS n, round((sij - sa * sb / (N0 * (N0 - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (N0 * (N0 - 1) / 2)), 6) AS ari, round(2 * mi / (ha + hb), 6) AS nmi, round(mi / ha, 6) AS homogeneity, round(mi / hb, 6) AS completeness, round(2 * (mi / ha) * (mi / hb) / (mi / ha + mi / hb), 6) AS v_measure, round(sij / sqrt(sa * sb), 6) AS fowlkes_mallows FROM j JOIN sa USING (slice_id) JOIN sb USING (slice_id)""")
def e11(spark, sf):
    s = spots(spark, sf).withColumn("cluster", F.concat(F.lit("c"), F.col("pos") % 7))
    return M.agreement(s, ["slice_id"], "label", "cluster")


_HIST = """top AS (SELECT max(l_quantity::DOUBLE) AS top FROM lineitem), h AS (SELECT l_linenumber % 2 AS side, least(floor(l_quantity::DOUBLE * 30 / top), 29)::INT AS bin, count(*) AS n FROM lineitem, top GROUP BY ALL),
p AS (SELECT side, bin, (coalesce(n, 0) + 1e-8) / (N0 + 30 * 1e-8) AS p FROM (SELECT side, sum(n) AS N0 FROM h GROUP BY side) CROSS JOIN (SELECT unnest(range(30))::INT AS bin) LEFT JOIN h USING (side, bin))"""


def _hist(spark, sf):
    li = table(spark, sf, "lineitem").select((F.col("l_linenumber") % 2).alias("side"), F.col("l_quantity").cast("double").alias("v"))
    top = li.agg(F.max("v")).first()[0]
    return M.histogram(li, ["side"], F.col("v"), F.lit(top), 30)


@q("E15", f", {_HIST} SELECT side, bin, round(p, 9) AS p FROM p")
def e15(spark, sf):
    return _hist(spark, sf).select(F.col("side"), "bin", F.round("p", 9).alias("p"))


@q("E14_jsd", f", {_HIST} SELECT 'all' AS g, round(sqrt(greatest(sum((a.p * ln(2 * a.p / (a.p + b.p)) + b.p * ln(2 * b.p / (a.p + b.p))) / 2), 0)), 6) AS jsd FROM p a JOIN p b ON a.bin = b.bin AND a.side = 0 AND b.side = 1")
def e14_jsd(spark, sf):
    h = _hist(spark, sf).withColumn("g", F.lit("all"))
    side = lambda k: h.where(F.col("side") == k).select("g", "bin", "p")
    return M.jensen_shannon(side(0), side(1), ["g"])


@q("E14_w1", """, v AS (SELECT value, sum((source = 'real')::INT) AS na, sum((source <> 'real')::INT) AS nb FROM (SELECT source, round(x, 4) AS value FROM spots) GROUP BY value),
f AS (SELECT value, sum(na) OVER (ORDER BY value) / sum(na) OVER () AS fa, sum(nb) OVER (ORDER BY value) / sum(nb) OVER () AS fb, lead(value) OVER (ORDER BY value) - value AS step FROM v) SELECT 'all' AS g, round(sum(abs(fa - fb) * step), 6) AS w1 FROM f""")
def e14_w1(spark, sf):
    side = lambda df: df.select(F.lit("all").alias("g"), F.round("x", 4).alias("value"))
    return M.wasserstein(side(real(spark, sf)), side(pool(spark, sf)), ["g"], "value")


@q("E16", "SELECT label, count(*) AS n, round(CASE WHEN count(*) > 1 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12 THEN covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) ELSE 0 END, 6) AS corr FROM spots GROUP BY label")
def e16(spark, sf):
    return M.safe_corr(spots(spark, sf), ["label"], "x", "y")


@q("E20", "SELECT o_custkey % 50 AS g, round(sum(w * v) / sum(w), 6) AS mean, round(sqrt(greatest(sum(w * v * v) / sum(w) - pow(sum(w * v) / sum(w), 2), 0)), 6) AS std FROM (SELECT o_custkey, o_totalprice::DOUBLE / 1000 AS v, 1 + o_orderkey % 4 AS w FROM orders) GROUP BY ALL")
def e20(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("g"), (F.col("o_totalprice").cast("double") / 1000).alias("v"), (1 + F.col("o_orderkey") % 4).alias("w"))
    return M.weighted_mean_std(o, ["g"], F.col("v"), F.col("w"))


@q("E40", "SELECT * FROM (VALUES ('accuracy', 'classification'), ('ari', 'clustering'), ('jsd', 'fidelity'), ('macro_f1', 'classification'), ('moran', 'spatial')) t(metric, family)")
def e40(spark, sf):
    return spark.createDataFrame([("accuracy", "classification"), ("ari", "clustering"), ("jsd", "fidelity"), ("macro_f1", "classification"), ("moran", "spatial")], "metric string, family string")


_AGG = _summary_sql(", agg AS (SELECT model, paradigm, ratio, alpha, classifier, round(avg(accuracy), 9) AS accuracy, round(avg(macro_f1), 9) AS macro_f1 FROM cls GROUP BY ALL)")


def _agg(spark, sf):
    return _summary(spark, sf).groupBy("model", "paradigm", "ratio", "alpha", "classifier").agg(*(F.round(F.avg(c), 9).alias(c) for c in ("accuracy", "macro_f1")))


_TIE = ["paradigm", "ratio", "alpha"]
_ORDER = "macro_f1 DESC, paradigm NULLS FIRST, ratio NULLS FIRST, alpha NULLS FIRST"


def _order():
    return [F.desc("macro_f1"), *(F.col(c) for c in _TIE)]


@q("G1", _AGG + f" SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY model, classifier ORDER BY {_ORDER}) = 1")
def g1(spark, sf):
    return R.top_k(_agg(spark, sf), ["model", "classifier"], _order())


@q("G2", _AGG + f" SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY model, classifier ORDER BY {_ORDER}) <= 5")
def g2(spark, sf):
    return R.top_k(_agg(spark, sf), ["model", "classifier"], _order(), 5)


@q("G3", _AGG + " SELECT model, ratio, alpha AS best_alpha, macro_f1 FROM (SELECT model, ratio, alpha, round(avg(macro_f1), 6) AS macro_f1 FROM agg WHERE ratio IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY model, ratio ORDER BY macro_f1 DESC, alpha NULLS FIRST) = 1")
def g3(spark, sf):
    a = _agg(spark, sf).where("ratio is not null").groupBy("model", "ratio", "alpha").agg(F.round(F.avg("macro_f1"), 6).alias("macro_f1"))
    return R.top_k(a, ["model", "ratio"], [F.desc("macro_f1"), F.col("alpha")]).withColumnRenamed("alpha", "best_alpha")


@q("G4", _AGG + ", long AS (SELECT model, 'accuracy' AS metric, accuracy AS value, paradigm, ratio, alpha FROM agg WHERE classifier = 'lr' UNION ALL SELECT model, 'macro_f1', macro_f1, paradigm, ratio, alpha FROM agg WHERE classifier = 'lr') SELECT * FROM long QUALIFY row_number() OVER (PARTITION BY model, metric ORDER BY value DESC, paradigm NULLS FIRST, ratio NULLS FIRST, alpha NULLS FIRST) = 1")
def g4(spark, sf):
    return R.best_by_each(_agg(spark, sf).where("classifier = 'lr'"), ["model"], ["accuracy", "macro_f1"], _TIE)


@q("G6", _summary_sql(f", {_DELTA} SELECT {_KEYS}, delta_macro_f1 FROM delta WHERE delta_macro_f1 IS NOT NULL ORDER BY delta_macro_f1 DESC, model, paradigm, ratio NULLS FIRST, alpha NULLS FIRST, classifier, slice_id, seed LIMIT 20"))
def g6(spark, sf):
    keys = _KEYS.split(", ")
    return _delta(spark, sf).where("delta_macro_f1 is not null").orderBy(F.desc("delta_macro_f1"), *keys).limit(20).select(*keys, "delta_macro_f1")


@q("G12", _AGG + " SELECT model, paradigm, arg_max(classifier, struct_pack(a := macro_f1, b := classifier, c := coalesce(ratio, -1), d := coalesce(alpha, -1))) AS classifier FROM agg GROUP BY ALL")
def g12(spark, sf):
    return _agg(spark, sf).groupBy("model", "paradigm").agg(F.max_by("classifier", F.struct("macro_f1", "classifier", F.coalesce("ratio", F.lit(-1.0)), F.coalesce("alpha", F.lit(-1.0)))).alias("classifier"))


@q("G7", "SELECT gene_idx, round(var_samp(value), 6) AS v FROM expr GROUP BY gene_idx ORDER BY v DESC, gene_idx LIMIT 20")
def g7(spark, sf):
    return expr(spark, sf).groupBy("gene_idx").agg(F.round(F.var_samp("value"), 6).alias("v")).orderBy(F.desc("v"), "gene_idx").limit(20)


@q("G9", "SELECT DISTINCT gene_idx FROM expr ORDER BY gene_idx LIMIT 25")
def g9(spark, sf):
    return expr(spark, sf).select("gene_idx").distinct().orderBy("gene_idx").limit(25)


@q("G11", "SELECT DISTINCT slice_id, label FROM real")
def g11(spark, sf):
    return real(spark, sf).select("slice_id", "label").distinct().orderBy("slice_id", "label")


@q("D3", _summary_sql(f", agg AS (SELECT model, paradigm, ratio, alpha, classifier, round(avg(macro_f1), 6) AS macro_f1 FROM cls GROUP BY ALL), best AS (SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY model, classifier ORDER BY {_ORDER}) = 1) SELECT c.model, c.paradigm, c.ratio, c.alpha, c.classifier, c.slice_id, c.seed, c.macro_f1 FROM cls c WHERE EXISTS (SELECT 1 FROM best b WHERE b.model = c.model AND b.paradigm = c.paradigm AND b.ratio IS NOT DISTINCT FROM c.ratio AND b.alpha IS NOT DISTINCT FROM c.alpha AND b.classifier = c.classifier)"))
def d3(spark, sf):
    keys = ["model", "paradigm", "ratio", "alpha", "classifier"]
    best = R.top_k(_agg(spark, sf), ["model", "classifier"], _order())
    return R.best_detail(_summary(spark, sf), best, keys).select(*keys, "slice_id", "seed", "macro_f1")


@q("D4", """, c AS (SELECT model, y_true, y_pred, count(*) AS n FROM pred WHERE paradigm = 'global' GROUP BY ALL), l AS (SELECT DISTINCT y_true AS l FROM c UNION SELECT DISTINCT y_pred FROM c), m AS (SELECT DISTINCT model FROM c)
SELECT m.model, a.l AS y_true, b.l AS y_pred, coalesce(n, 0) AS n, round(coalesce(coalesce(n, 0) / nullif(sum(coalesce(n, 0)) OVER (PARTITION BY m.model, a.l), 0), 0), 6) AS share FROM m, l a, l b LEFT JOIN c ON c.model = m.model AND c.y_true = a.l AND c.y_pred = b.l""")
def d4(spark, sf):
    return dense_confusion(predictions(spark, sf).where("paradigm = 'global'"), ["model"])


def dense_confusion(pred, by):
    """Confusion counts and row shares over the union of labels, absent cells 0; only counted rows and labels meet."""
    c = M.confusion(pred, by)
    labels = c.select(F.col("y_true").alias("l")).union(c.select("y_pred")).distinct()
    grid = c.select(*by).distinct().crossJoin(labels.withColumnRenamed("l", "y_true")).crossJoin(labels.withColumnRenamed("l", "y_pred"))
    full = grid.join(c, [*by, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    row = F.sum("n").over(W.partitionBy(*by, "y_true"))
    return full.withColumn("share", F.round(F.coalesce(F.try_divide(F.col("n"), row), F.lit(0.0)), 6))


@q("E41", _summary_sql(", agg AS (SELECT model, classifier, 't' || seed AS split_tag, ratio, round(avg(macro_f1), 6) AS macro_f1 FROM cls WHERE ratio IS NOT NULL GROUP BY ALL), best AS (SELECT * FROM agg QUALIFY row_number() OVER (PARTITION BY model, classifier, split_tag ORDER BY macro_f1 DESC, ratio) = 1), c AS (SELECT model, classifier, round_even(avg(ratio), 0)::INT AS center FROM best GROUP BY ALL) SELECT *, array_to_string(range(greatest(least(center - 5, 31), 1), greatest(least(center - 5, 31), 1) + 10), ',') AS weighted_ratio_window FROM c"))
def e41(spark, sf):
    agg = _summary(spark, sf).where("ratio is not null").groupBy("model", "classifier", F.concat(F.lit("t"), "seed").alias("split_tag"), "ratio").agg(F.round(F.avg("macro_f1"), 6).alias("macro_f1"))
    return R.ratio_windows(agg, "macro_f1")


@q("C18", "SELECT p.model, p.ratio, p.slice_id, count(*) AS n FROM pred p JOIN (SELECT model, ratio FROM pred WHERE ratio <= 3 GROUP BY ALL HAVING count(DISTINCT slice_id) >= 4) f ON p.model = f.model AND p.ratio = f.ratio GROUP BY ALL UNION ALL SELECT model, ratio, slice_id, count(*) FROM pred WHERE paradigm = 'baseline' GROUP BY ALL")
def c18(spark, sf):
    kept = R.complete_variants(predictions(spark, sf), ["model", "ratio"], "slice_id", 4, F.col("paradigm") == "baseline", 3.0)
    return kept.groupBy("model", "ratio", "slice_id").agg(F.count("*").alias("n"))


@q("D20", "SELECT model, ratio, count(*) AS n FROM pred SEMI JOIN (SELECT model, ratio FROM pred WHERE ratio IS NOT NULL GROUP BY ALL HAVING count(DISTINCT slice_id) >= 4) USING (model, ratio) GROUP BY ALL")
def d20(spark, sf):
    p = predictions(spark, sf).where("ratio is not null")
    return R.complete_variants(p, ["model", "ratio"], "slice_id", 4, F.lit(False)).groupBy("model", "ratio").agg(F.count("*").alias("n"))


@q("C17", "SELECT obs_name FROM pred WHERE ratio IN (1, 2) AND (alpha IS NULL OR alpha IN (0.5))")
def c17(spark, sf):
    return predictions(spark, sf).where(F.col("ratio").isin(1.0, 2.0) & (F.col("alpha").isNull() | F.col("alpha").isin(0.5))).select("obs_name")


@q("I1", _summary_sql("SELECT model, round(avg(CASE WHEN paradigm = 'baseline' THEN macro_f1 END), 6) AS baseline, round(avg(CASE WHEN paradigm = 'global' THEN macro_f1 END), 6) AS \"global\" FROM cls GROUP BY model"))
def i1(spark, sf):
    p = _summary(spark, sf).groupBy("model").pivot("paradigm", ["baseline", "global"]).agg(F.avg("macro_f1"))
    return p.select("model", *(F.round(c, 6).alias(c) for c in ("baseline", "global")))


@q("I2", "SELECT label AS t, 'c' || (pos % 7) AS p, count(*) AS n FROM spots GROUP BY ALL")
def i2(spark, sf):
    return spots(spark, sf).groupBy(F.col("label").alias("t"), F.concat(F.lit("c"), F.col("pos") % 7).alias("p")).agg(F.count("*").alias("n"))


@q("I3", _summary_sql("SELECT ratio, round(avg(CASE WHEN classifier = 'lr' THEN macro_f1 END), 6) AS lr, round(avg(CASE WHEN classifier = 'mlp' THEN macro_f1 END), 6) AS mlp FROM cls WHERE ratio IS NOT NULL GROUP BY ratio"))
def i3(spark, sf):
    p = _summary(spark, sf).where("ratio is not null").groupBy("ratio").pivot("classifier", ["lr", "mlp"]).agg(F.avg("macro_f1"))
    return p.select("ratio", *(F.round(c, 6).alias(c) for c in ("lr", "mlp")))


@q("I4", "SELECT y_true, " + ", ".join(f"round(count(*) FILTER (y_pred = 'L{k}') / count(*), 6) AS L{k}" for k in range(5)) + " FROM pred GROUP BY y_true")
def i4(spark, sf):
    names = [f"L{k}" for k in range(5)]
    p = predictions(spark, sf).groupBy("y_true").pivot("y_pred", names).count().na.fill(0)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return p.select("y_true", *(F.round(F.col(n) / total, 6).alias(n) for n in names))


@q("I5", "SELECT 'm' || (event_id % 10) AS model, 'r' || (event_id % 3) AS region, sum(user_id % 10) AS n FROM events GROUP BY ALL")
def i5(spark, sf):
    e = table(spark, sf, "events").select(F.concat(F.lit("m"), F.col("event_id") % 10).alias("model"), F.create_map(F.concat(F.lit("r"), F.col("event_id") % 3), F.col("user_id") % 10).alias("profile"))
    return e.select("model", F.explode("profile").alias("region", "v")).groupBy("model", "region").agg(F.sum("v").alias("n"))


@q("I6", _AGG + " SELECT model, classifier, max(macro_f1) AS best FROM agg GROUP BY ALL")
def i6(spark, sf):
    return _agg(spark, sf).groupBy("model", "classifier").agg(F.max("macro_f1").alias("best"))


@q("I7", _AGG + " SELECT model, paradigm, round(avg(accuracy), 6) AS accuracy, round(avg(macro_f1), 6) AS macro_f1 FROM agg GROUP BY ALL")
def i7(spark, sf):
    return _agg(spark, sf).groupBy("model", "paradigm").agg(*(F.round(F.avg(c), 6).alias(c) for c in ("accuracy", "macro_f1")))


@q("I8", "SELECT event_id, 'L' || (event_id % 3) AS label, 'r0' AS region, user_id AS n FROM events UNION ALL SELECT event_id, 'L' || (event_id % 3), 'r1', 2 FROM events")
def i8(spark, sf):
    text = F.concat(F.lit('{"profile":{"L'), F.col("event_id") % 3, F.lit('":{"r0":'), F.col("user_id"), F.lit(',"r1":2}}}'))
    e = table(spark, sf, "events").select("event_id", F.from_json(text, "profile map<string,map<string,bigint>>")["profile"].alias("p"))
    return e.select("event_id", F.explode("p").alias("label", "regions")).select("event_id", "label", F.explode("regions").alias("region", "n"))


@q("I9", "SELECT 'q' || k AS sample, n_nationkey, v FROM (SELECT n_nationkey, unnest([1, 2, 3]) AS k, unnest([n_nationkey * 1.5, n_nationkey * 2.5, n_regionkey * 1.0]::DOUBLE[]) AS v FROM nation)")
def i9(spark, sf):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    wide = table(spark, sf, "nation").select(n, (n * 1.5).alias("q1"), (n * 2.5).alias("q2"), (r * 1.0).alias("q3"))
    return wide.unpivot("n_nationkey", ["q1", "q2", "q3"], "sample", "v").select("sample", "n_nationkey", F.col("v").cast("double").alias("v"))
