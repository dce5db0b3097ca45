"""Clustering jobs, inputs of paradigms, views of generators, patches and embeddings that are done once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as J
from ..sources import bundle as B
from ..sources import package as K
from ..sources import runs as R
from .registry import expr, pool, query, real, spots


def _lloyd(k: int, rounds: int) -> str:
    """Lloyd's rounds as a chain of tables: centres c<i>, nearest centres a<i>."""
    out = ["p AS (SELECT slice_id, obs_name, seed, x, y FROM spots, (SELECT unnest([1, 2]) AS seed))", f"c0 AS (SELECT slice_id, seed, r - 1 AS c, x AS cx, y AS cy FROM (SELECT *, row_number() OVER (PARTITION BY slice_id, seed ORDER BY md5(seed || '||' || obs_name), obs_name) AS r FROM p) WHERE r <= {k})"]
    for i in range(rounds + 1):
        out.append(f"a{i} AS (SELECT p.*, c FROM p JOIN c{i} USING (slice_id, seed) QUALIFY row_number() OVER (PARTITION BY slice_id, seed, obs_name ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), c) = 1)")
        out.append(f"c{i + 1} AS (SELECT slice_id, seed, c, coalesce(avg(x), any_value(cx)) AS cx, coalesce(avg(y), any_value(cy)) AS cy FROM c{i} LEFT JOIN a{i} USING (slice_id, seed, c) GROUP BY ALL)")
    return ", ".join(out[:-1])


@query("N11", f", {_lloyd(5, 3)} SELECT slice_id, obs_name, spots.label, seed AS cluster_seed, c AS pred_cluster FROM a3 JOIN spots USING (slice_id, obs_name)")
def n11(spark, sf):
    """Seed 1 first; the second call has only the jobs of seed 2 left to do, the third none."""
    rows = spots(spark, sf).select("slice_id", "obs_name", "label", F.array("x", "y").alias("v"))
    root = B.scratch(spark, "jobs")
    for seeds in ([1], [1, 2], [2]):
        J.cluster_missing(spark, rows, root, "slice_id", "obs_name", "v", 5, seeds, rounds=3)
    return J.clusters(spark, root)


@query("A40", """, r AS (SELECT 'spot' || spot AS obs_name, gene_idx, value FROM expr)
SELECT 'real' AS side, obs_name, gene_idx - 20 AS gene_idx, 'g' || gene_idx AS gene, value FROM r SEMI JOIN (SELECT obs_name FROM real WHERE slice_id <> 's3') USING (obs_name) WHERE gene_idx >= 20
UNION ALL SELECT 'pool', obs_name, gene_idx, 'g' || (gene_idx + 20), value FROM r WHERE gene_idx < 40""")
def a40(spark, sf):
    """Genes g0 to g59 on the real side and g20 to g79 on the other, slices of test left out."""
    e = expr(spark, sf).select(F.concat(F.lit("spot"), "spot").alias("obs_name"), "gene_idx", "value")
    genes = lambda shift: e.select(F.concat(F.lit("g"), F.col("gene_idx") + shift).alias("gene"), "gene_idx").distinct()
    split = F.when(F.col("slice_id") == "s3", "test").otherwise("train")
    root = B.scratch(spark, "paradigm")
    K.write_package(spark, f"{root}/real", {"spots": real(spark, sf).withColumn("split", split), "genes": genes(0), "expr": e})
    K.write_package(spark, f"{root}/pool", {"spots": pool(spark, sf), "genes": genes(20), "expr": e}, {"generator": "gan"})
    one, two, _ = R.paradigm_inputs(spark, f"{root}/real", f"{root}/pool", root, "tissue", "unsupervised")
    sides = [t["expr"].join(t["genes"], "gene_idx").select(F.lit(n).alias("side"), "obs_name", "gene_idx", "gene", "value") for n, t in (("real", one), ("pool", two))]
    return sides[0].unionByName(sides[1])


@query("A27", ", m AS (SELECT unnest(['gan', 'splat', 'counts']) AS model) SELECT model, obs_name, slice_id, x, y, CASE WHEN model = 'counts' THEN NULL ELSE vec END AS vec FROM spots, m")
def a27(spark, sf):
    """Two generators read the canonical input through a link, one a view of its own."""
    root = B.scratch(spark, "views")
    K.write_package(spark, f"{root}/canonical", {"data": spots(spark, sf).drop("label", "source", "pos")})
    R.write_model_views(spark, f"{root}/inputs", f"{root}/canonical", "unsupervised", {"gan": None, "splat": None, "counts": lambda df: df.drop("vec")})
    out = None
    for model in ("gan", "splat", "counts"):
        view = R.read_model_view(spark, f"{root}/inputs", model, "unsupervised")
        view = view if "vec" in view.columns else view.withColumn("vec", F.lit(None).cast("array<double>"))
        view = view.select(F.lit(model).alias("model"), "obs_name", "slice_id", "x", "y", "vec")
        out = view if out is None else out.unionByName(view)
    return out


#: Images of 16 columns, one a slice: the n-th spot of a slice is its n-th pixel, and the centre of a patch.
_PIXELS = "px AS (SELECT obs_name, slice_id AS image, ((pos // 8) * 2 + pos % 2) // 16 AS row, ((pos // 8) * 2 + pos % 2) % 16 AS col, floor(x * 1000) AS value FROM spots)"
_PATCHES = f"{_PIXELS}, o AS (SELECT a.v - 2 AS dr, b.v - 2 AS dc FROM range(5) a(v), range(5) b(v)), pa AS (SELECT c.obs_name AS key, list(coalesce(p.value, 0) ORDER BY dr, dc) AS pixels FROM px c CROSS JOIN o LEFT JOIN px p ON p.image = c.image AND p.row = c.row + dr AND p.col = c.col + dc GROUP BY c.obs_name)"


def _patches(spark, sf):
    n = F.floor(F.col("pos") / 8) * 2 + F.col("pos") % 2
    px = spots(spark, sf).select(F.col("obs_name").alias("key"), F.col("slice_id").alias("image"), F.floor(n / 16).alias("row"), (n % 16).alias("col"), F.floor(F.col("x") * 1000).cast("double").alias("value"))
    return R.cropped(px.drop("key"), px.drop("value"), 2, tile=8)


@query("A22", f", {_PATCHES} SELECT key, pixels FROM pa")
def a22(spark, sf):
    return _patches(spark, sf)


def _summary():
    """A model of two numbers a patch: its sum and its greatest value."""
    import numpy as np

    return lambda x: np.stack([x.sum(axis=1), x.max(axis=1)], axis=1)


@query("A23", f", {_PATCHES} SELECT key, list_sum(pixels) AS total, list_max(pixels) AS top FROM pa")
def a23(spark, sf):
    """Patches of names that begin with spot1 first; the second call embeds the others alone."""
    p = B.stored(_patches(spark, sf), "patches")
    root = B.scratch(spark, "embeddings")
    R.embed_missing(spark, p.where("key like 'spot1%'"), root, _summary, 2)
    R.embed_missing(spark, p, root, _summary, 2)
    e = R.embeddings(spark, root)
    return e.select("key", *(F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(("total", "top"))))
