"""Queries for the histology axis, coordinates and preparation recipes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coordinates as Z
from ..operators import features as X
from ..operators import histology as H
from ..operators import recipes as R
from .registry import expr, pool, query, real, spots, table


def _pixels(spark, sf):
    """One image: a row for each vector, a column for each of its entries, three channels of whole numbers."""
    p = table(spark, sf, "embeddings").select(F.lit("slide").alias("image"), F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return p.select("image", "row", "col", F.floor(F.col("v").cast("double") * 100).alias("c0"), F.floor(F.abs(F.col("v")).cast("double") * 50).alias("c1"), ((F.col("row") * F.col("col")) % 17).alias("c2"))


@query("E39", """, px AS (SELECT vec_id AS r, k - 1 AS c, floor(embedding[k]::DOUBLE * 100)::BIGINT AS c0, floor(abs(embedding[k])::DOUBLE * 50)::BIGINT AS c1, (vec_id * (k - 1)) % 17 AS c2 FROM embeddings, (SELECT unnest(range(1, 65)) AS k)),
m AS (SELECT vec_id, avg(c0) AS c0, avg(c1) AS c1, avg(c2) AS c2 FROM embeddings JOIN px ON r BETWEEN vec_id - 24 AND vec_id + 24 AND c BETWEEN (vec_id * 7) % 64 - 24 AND (vec_id * 7) % 64 + 24 GROUP BY vec_id)
SELECT vec_id, round((c0 * var_pop(c0) OVER () + c1 * var_pop(c1) OVER () + c2 * var_pop(c2) OVER ()) / (var_pop(c0) OVER () + var_pop(c1) OVER () + var_pop(c2) OVER ()), 6) AS grey FROM m""")
def e39(spark, sf):
    at = table(spark, sf, "embeddings").select(F.lit("slide").alias("image"), "vec_id", F.col("vec_id").alias("row"), ((F.col("vec_id") * 7) % 64).alias("col"))
    channels = ["c0", "c1", "c2"]
    means = H.patch_means(at, _pixels(spark, sf), channels, "vec_id", 49, tile=32)
    return H.histology_axis(means, channels, "vec_id").select("vec_id", F.round("grey", 6).alias("grey"))


@query("J29_samples")
def j29_samples(spark, sf):
    drawn = Z.sampled_from_mixture(pool(spark, sf).select("obs_name"), X.mixture(real(spark, sf), 3), "obs_name")
    return drawn.select("obs_name", "component", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _u(number: int) -> str:
    return f"(('0x' || substr(md5('42|{number}|' || obs_name), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656"


_LEVELS = "CASE l WHEN 0 THEN 'label|' || slice_id || '|' || label WHEN 1 THEN 'slice|' || slice_id ELSE 'all' END"


#: References of some labels and of one slice are missing, so that every level of the cascade is taken.
@query("J30", f""", ref AS (SELECT * FROM real WHERE label NOT IN ('L1', 'L2') AND slice_id <> 's3'), lv AS (SELECT unnest([0, 1, 2]) AS l),
pools AS (SELECT {_LEVELS} AS pool, obs_name AS k, x, y FROM ref, lv),
sizes AS (SELECT pool, count(*) AS n, greatest(stddev_pop(x) * 0.08, 1e-6) AS sx, greatest(stddev_pop(y) * 0.08, 1e-6) AS sy FROM pools GROUP BY pool),
cond AS (SELECT slice_id, label, l, {_LEVELS} AS pool FROM (SELECT DISTINCT slice_id, label FROM pool), lv),
chosen AS (SELECT slice_id, label, min(l) AS l, arg_min(pool, l) AS pool, arg_min(n, l) AS n, arg_min(sx, l) AS sx, arg_min(sy, l) AS sy FROM cond JOIN sizes USING (pool) WHERE n >= 3 OR l = 2 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY k) - 1 AS place FROM pools),
met AS (SELECT p.obs_name, c.*, floor({_u(0)} * n) AS place, sqrt(-2 * ln({_u(1)})) AS len, 2 * pi() * {_u(2)} AS angle FROM pool p JOIN chosen c USING (slice_id, label))
SELECT obs_name, ['label', 'slice', 'jitter'][l + 1] AS coord_source, round(x + sx * len * cos(angle), 6) AS x, round(y + sy * len * sin(angle), 6) AS y FROM met JOIN ranked USING (pool, place)""")
def j30(spark, sf):
    reference = real(spark, sf).where("label not in ('L1', 'L2') and slice_id != 's3'")
    out = Z.near_references(pool(spark, sf).select("obs_name", "slice_id", "label"), reference, "obs_name", least=3)
    return out.select("obs_name", "coord_source", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _tables(spark, sf):
    """Expression of 400 spots and what is known of them: slice, sample and label, some unknown."""
    e = expr(spark, sf)
    s = F.col("spot")
    label = F.when(s % 11 == 0, "unknown").otherwise(F.concat(F.lit("L"), (s % 40) % 3))
    return {"expr": e, "obs": e.select("spot").distinct().select("spot", F.concat(F.lit("s"), s % 4).alias("slice_id"), F.concat(F.lit("p"), s % 40).alias("sample"), label.alias("label"))}


_OBS = "obs AS (SELECT DISTINCT spot, 's' || (spot % 4) AS slice_id, 'p' || (spot % 40) AS sample, CASE WHEN spot % 11 = 0 THEN 'unknown' ELSE 'L' || ((spot % 40) % 3) END AS label FROM expr)"
_LOG = "lg AS (SELECT spot, gene_idx, ln(1 + value * {t} / sum(value) OVER (PARTITION BY spot)) AS value FROM {f}), top AS (SELECT gene_idx FROM lg GROUP BY gene_idx ORDER BY round(coalesce(var_samp(value), 0), 9) DESC, gene_idx LIMIT {n})"


@query("A38", f""", {_OBS}, g AS (SELECT gene_idx FROM expr WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT spot) >= 100), k AS (SELECT * FROM expr SEMI JOIN g USING (gene_idx)),
fs AS (SELECT spot FROM k WHERE value > 0 GROUP BY 1 HAVING count(DISTINCT gene_idx) >= 12), f AS (SELECT * FROM k SEMI JOIN fs USING (spot)), {_LOG.format(t='1e4', f='f', n=20)},
sp AS (SELECT *, CASE WHEN r <= greatest(least(round_even(n * 0.5, 0), n - 1), 1) THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY slice_id, label ORDER BY md5('42||' || spot), spot) AS r, count(*) OVER (PARTITION BY slice_id, label) AS n FROM obs SEMI JOIN fs USING (spot)))
SELECT spot, gene_idx, round(value, 6) AS value, slice_id, label, split FROM lg SEMI JOIN top USING (gene_idx) JOIN sp USING (spot)""")
def a38(spark, sf):
    view = R.prepared(R.SPOTS, _tables(spark, sf), {"expr.counts", "obs.label"})["view"]
    return view.withColumn("value", F.round("value", 6))


@query("A38_samples", f""", {_OBS}, ob AS (SELECT * FROM obs WHERE label <> 'unknown'), f AS (SELECT expr.* FROM expr SEMI JOIN ob USING (spot)), {_LOG.format(t='1e3', f='f', n=15)},
gr AS (SELECT sample, label FROM (SELECT sample, label, row_number() OVER (PARTITION BY sample ORDER BY c DESC, label) AS o FROM (SELECT sample, label, count(*) AS c FROM ob GROUP BY sample, label)) WHERE o = 1),
rk AS (SELECT sample, row_number() OVER (PARTITION BY label ORDER BY md5('42||' || sample), sample) AS r, count(*) OVER (PARTITION BY label) AS n FROM gr),
sp AS (SELECT sample, CASE WHEN r <= greatest(floor(n * 0.6), 1) THEN 'train' WHEN r <= greatest(floor(n * 0.6), 1) + CASE WHEN n > 2 THEN greatest(floor(n * 0.2), 1) ELSE 0 END THEN 'val' ELSE 'test' END AS split FROM rk)
SELECT spot, gene_idx, round(value, 6) AS value, sample, split FROM lg SEMI JOIN top USING (gene_idx) JOIN ob USING (spot) JOIN sp USING (sample)""")
def a38_samples(spark, sf):
    view = R.prepared(R.SAMPLES, _tables(spark, sf), {"expr.counts", "obs.label", "obs.group"})["view"]
    return view.withColumn("value", F.round("value", 6))


@query("F17", f", {_OBS} SELECT spot, 'all' AS split FROM obs")
def f17(spark, sf):
    """The split that the data set's kind and mode ask for; here the unsupervised one, whose labels are gone."""
    obs = R.prepared([R.split_step("spots", "unsupervised")], _tables(spark, sf), {"expr.counts", "obs.label"})["obs"]
    return obs.select("spot", "split")
