"""Queries for neighbour joins, graphs and spatial statistics."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import paradigm as P
from ..operators import spatial as N
from ..operators import tiles as T
from .registry import pool, query, real, spots


def _xy(df):
    return df.withColumn("vec", F.array("x", "y"))


_D = "round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 9)"


def _nn(a: str, b: str, k: int, other: str = "") -> str:
    return f"nn AS (SELECT slice_id, obs_name, neighbour, d, r FROM (SELECT a.slice_id, a.obs_name, b.obs_name AS neighbour, {_D} AS d, row_number() OVER (PARTITION BY a.obs_name ORDER BY {_D}, b.obs_name) AS r FROM {a} a JOIN {b} b USING (slice_id) {other}) WHERE r <= {k})"


_SELF = "WHERE a.obs_name <> b.obs_name"


@query("D8", "SELECT obs_name, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM (SELECT a.obs_name, b.x, b.y, row_number() OVER (PARTITION BY a.obs_name ORDER BY round(1 - list_cosine_similarity(a.vec, b.vec), 9), b.obs_name) AS r FROM pool a JOIN real b USING (slice_id)) WHERE r <= 10 GROUP BY obs_name")
def d8(spark, sf):
    nn = N.knn_join(pool(spark, sf), real(spark, sf), "slice_id", "obs_name", "vec", 10)
    return N.mapped_coordinates(nn, real(spark, sf), "slice_id", "obs_name").select("obs_name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query("D9", f""", want AS (SELECT slice_id, greatest(round_even(count(*) * 0.3, 0), 1) AS n FROM real GROUP BY slice_id),
near AS (SELECT slice_id, neighbour, r FROM (SELECT a.slice_id, b.obs_name AS neighbour, row_number() OVER (PARTITION BY a.obs_name ORDER BY {_D}, b.obs_name) AS r FROM real a JOIN pool b USING (slice_id)))
SELECT obs_name FROM (SELECT p.obs_name, n, row_number() OVER (PARTITION BY p.slice_id ORDER BY pos) AS k FROM pool p JOIN want USING (slice_id) SEMI JOIN (SELECT DISTINCT neighbour FROM near JOIN want USING (slice_id) WHERE r <= n) c ON c.neighbour = p.obs_name) WHERE k <= n""")
def d9(spark, sf):
    r = _xy(real(spark, sf))
    return N.nearest_selection(r, _xy(pool(spark, sf)), N.wanted_by_ratio(r, "slice_id", 0.3), "slice_id", "obs_name", "vec", "pos").select("obs_name")


_CELL = "least(greatest(floor(({c} - min({c}) OVER w) / greatest(max({c}) OVER w - min({c}) OVER w, 1e-9) * 3), 0), 2)::INT"
_GRID = f"grid AS (SELECT *, {_CELL.format(c='x')} || '_' || {_CELL.format(c='y')} AS cell FROM spots WINDOW w AS (PARTITION BY slice_id))"


_REAL_CELL = _CELL.replace(") OVER w", ") FILTER (source = 'real') OVER w")


@query("D10", f""", cells AS (SELECT *, slice_id || '|' || {_REAL_CELL.format(c='x')} || '|' || {_REAL_CELL.format(c='y')} AS cell FROM spots WINDOW w AS (PARTITION BY slice_id)),
counts AS (SELECT cell, count(*) AS c FROM cells WHERE source = 'real' GROUP BY cell),
ranked AS (SELECT cell, c, row_number() OVER (ORDER BY c DESC, cell) - 1 AS rank, count(*) OVER () AS groups FROM counts),
want AS (SELECT cell, c * (1 + CASE WHEN groups = 1 THEN 2 ELSE round_even(rank * 2.0::DOUBLE / (groups - 1), 0) END) AS n FROM ranked),
near AS (SELECT a.cell, b.obs_name AS neighbour, row_number() OVER (PARTITION BY a.obs_name ORDER BY {_D}, b.obs_name) AS r FROM cells a JOIN cells b ON a.cell = b.cell AND a.source = 'real' AND b.source = 'synthetic')
SELECT obs_name FROM (SELECT p.obs_name, n, row_number() OVER (PARTITION BY p.cell ORDER BY pos) AS k FROM cells p JOIN want USING (cell) SEMI JOIN (SELECT DISTINCT neighbour FROM near JOIN want USING (cell) WHERE r <= n) c ON c.neighbour = p.obs_name) WHERE k <= n""")
def d10(spark, sf):
    g = _xy(P.grid_regions(spots(spark, sf), "slice_id", 3, F.col("source") == "real"))
    r = g.where("source = 'real'")
    return N.nearest_selection(r, g.where("source = 'synthetic'"), N.wanted_by_density(r, "region", 3), "region", "obs_name", "vec", "pos").select("obs_name")


@query("D11", f", {_nn('pool', 'real', 5)} SELECT nn.obs_name, round(quantile_cont(b.x, 0.5), 6) AS x, round(quantile_cont(b.y, 0.5), 6) AS y FROM nn JOIN real b ON b.obs_name = nn.neighbour GROUP BY nn.obs_name")
def d11(spark, sf):
    nn = N.knn_join(_xy(pool(spark, sf)), _xy(real(spark, sf)), "slice_id", "obs_name", "vec", 5, "euclidean")
    return N.mapped_coordinates(nn, real(spark, sf), "slice_id", "obs_name", "median").select("obs_name", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


_NEAR = "SELECT a.slice_id, a.obs_name, a.label, b.obs_name AS neighbour, b.label AS other FROM spots a JOIN spots b ON a.slice_id = b.slice_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.05 * 0.05"


@query("D12", f"SELECT obs_name, count(*) AS n FROM ({_NEAR}) GROUP BY obs_name")
def d12(spark, sf):
    s = spots(spark, sf)
    return N.radius_join(s, s, "slice_id", "obs_name", 0.05).groupBy("obs_name").agg(F.count("*").alias("n"))


@query("D13", "SELECT a.obs_name, b.label AS other, count(*) AS n FROM spots a JOIN spots b ON a.slice_id = b.slice_id AND abs(a.x - b.x) < 0.05 AND abs(a.y - b.y) < 0.05 GROUP BY ALL")
def d13(spark, sf):
    s = spots(spark, sf)
    near = N.radius_join(s, s, "slice_id", "obs_name", 0.05, box=True)
    return near.join(s.select(F.col("obs_name").alias("neighbour"), F.col("label").alias("other")), "neighbour").groupBy("obs_name", "other").agg(F.count("*").alias("n"))


@query("D14", f", c AS (SELECT slice_id, label, other, count(*) AS n FROM ({_NEAR}) WHERE label = 'L1' AND other <> 'L1' GROUP BY ALL), z AS (SELECT slice_id, label AS other, count(*) AS size FROM spots GROUP BY ALL) SELECT slice_id, other, n FROM c JOIN z USING (slice_id, other) WHERE n > 0.2 * size")
def d14(spark, sf):
    s = spots(spark, sf)
    near = N.radius_join(s.where("label = 'L1'"), s, "slice_id", "obs_name", 0.05)
    other = near.join(s.select("slice_id", F.col("obs_name").alias("neighbour"), F.col("label").alias("other")), ["slice_id", "neighbour"]).where("other != 'L1'")
    sizes = s.groupBy("slice_id", F.col("label").alias("other")).agg(F.count("*").alias("size"))
    return other.groupBy("slice_id", "other").agg(F.count("*").alias("n")).join(sizes, ["slice_id", "other"]).where("n > 0.2 * size").select("slice_id", "other", "n")


@query("D15", "SELECT a.obs_name AS src, b.obs_name AS dst, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) AS d FROM real a JOIN real b USING (slice_id)")
def d15(spark, sf):
    # F.round goes through a decimal string for each of the pairs
    return N.pairwise(real(spark, sf), "slice_id", "obs_name").select("src", "dst", (F.floor(F.col("d") * 1e6 + 0.5) / 1e6).alias("d"))


_GRAPH = f"{_nn('spots', 'spots', 6, _SELF)}, g AS (SELECT slice_id, src, dst, max(w) AS w FROM (SELECT slice_id, obs_name AS src, neighbour AS dst, 1.0::DOUBLE AS w FROM nn UNION ALL SELECT slice_id, neighbour, obs_name, 1.0 FROM nn) GROUP BY ALL)"


def _neighbours(spark, sf, k=6):
    s = _xy(spots(spark, sf))
    return N.knn_join(s, s, "slice_id", "obs_name", "vec", k, "euclidean", exclude_self=True)


@query("D16", f", {_GRAPH} SELECT * FROM g")
def d16(spark, sf):
    return N.symmetric_graph(_neighbours(spark, sf), "slice_id", "obs_name")


@query("D16_gaussian", f", {_nn('spots', 'spots', 6, _SELF)}, s AS (SELECT slice_id, quantile_cont(d, 0.5) AS s FROM nn WHERE d > 0 GROUP BY slice_id), e AS (SELECT slice_id, obs_name AS src, neighbour AS dst, exp(-d * d / (2 * s * s)) AS w FROM nn JOIN s USING (slice_id)) SELECT slice_id, src, dst, round(max(w), 6) AS w FROM (SELECT * FROM e UNION ALL SELECT slice_id, dst, src, w FROM e) GROUP BY ALL")
def d16_gaussian(spark, sf):
    return N.symmetric_graph(_neighbours(spark, sf), "slice_id", "obs_name", gaussian=True).withColumn("w", F.round("w", 6))


@query("D17", "SELECT obs_name FROM pool a WHERE NOT EXISTS (SELECT 1 FROM real b WHERE a.slice_id = b.slice_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.02 * 0.02)")
def d17(spark, sf):
    p = pool(spark, sf)
    return p.join(N.radius_join(p, real(spark, sf), "slice_id", "obs_name", 0.02), "obs_name", "left_anti").select("obs_name")


@query("K2", f", {_nn('spots', 'spots', 6, _SELF)} SELECT obs_name, neighbour, d AS distance, r::INT AS rank FROM nn")
def k2(spark, sf):
    return _neighbours(spark, sf).select("obs_name", "neighbour", "distance", "rank")


_MORAN = "z AS (SELECT slice_id, obs_name, x - avg(x) OVER (PARTITION BY slice_id) AS z FROM spots), ss AS (SELECT slice_id, count(*) AS n, sum(z * z) AS ss FROM z GROUP BY slice_id)"


@query("E18", f", {_GRAPH}, {_MORAN} SELECT slice_id, round(any_value(n) * sum(w * a.z * b.z) / (sum(w) * any_value(ss)), 6) AS moran FROM g JOIN z a ON a.obs_name = src JOIN z b ON b.obs_name = dst JOIN ss ON ss.slice_id = g.slice_id GROUP BY g.slice_id".replace("SELECT slice_id, round(any_value(n)", "SELECT g.slice_id, round(any_value(n)"))
def e18(spark, sf):
    return N.morans_i(spots(spark, sf).select("slice_id", "obs_name", "x"), d16(spark, sf), ["slice_id"], "obs_name", "x")


@query("E19", f", {_GRAPH}, {_MORAN} SELECT g.slice_id, round((any_value(n) - 1) * sum(w * (a.z - b.z) * (a.z - b.z)) / (2 * sum(w) * any_value(ss)), 6) AS geary FROM g JOIN z a ON a.obs_name = src JOIN z b ON b.obs_name = dst JOIN ss ON ss.slice_id = g.slice_id GROUP BY g.slice_id")
def e19(spark, sf):
    return N.gearys_c(spots(spark, sf).select("slice_id", "obs_name", "x"), d16(spark, sf), ["slice_id"], "obs_name", "x")


@query("E17", f""", {_GRAPH}, v AS (SELECT slice_id, obs_name, k AS gene, vec[k] AS v FROM spots, (SELECT unnest(range(1, 65)) AS k)), z AS (SELECT slice_id, obs_name, gene, v - avg(v) OVER (PARTITION BY slice_id, gene) AS z FROM v), ss AS (SELECT slice_id, gene, count(*) AS n, sum(z * z) AS ss FROM z GROUP BY ALL),
m AS (SELECT g.slice_id, a.gene, round(any_value(n) * sum(w * a.z * b.z) / (sum(w) * any_value(ss)), 6) AS m FROM g JOIN z a ON a.obs_name = src JOIN z b ON b.obs_name = dst AND a.gene = b.gene JOIN ss ON ss.slice_id = g.slice_id AND ss.gene = a.gene GROUP BY ALL) SELECT slice_id, round(avg(m), 5) AS moran FROM m GROUP BY slice_id""")
def e17(spark, sf):
    v = spots(spark, sf).select("slice_id", "obs_name", F.posexplode("vec").alias("gene", "v"))
    per = N.morans_i(v, d16(spark, sf), ["slice_id", "gene"], "obs_name", "v")
    return per.groupBy("slice_id").agg(F.round(F.avg("moran"), 5).alias("moran"))


@query("E38", "SELECT slice_id, round(avg(s) - 1, 6) AS p FROM (SELECT a.slice_id, a.obs_name, sum(exp(-(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / (2 * 0.1 * 0.1))) AS s FROM spots a JOIN spots b USING (slice_id) GROUP BY ALL) GROUP BY slice_id")
def e38(spark, sf):
    return T.adjacency_scales(spots(spark, sf), "slice_id", "obs_name", [0.1]).select("slice_id", F.round("p", 6).alias("p"))


@query("N15")
def n15(spark, sf):
    return T.search_length(real(spark, sf), "slice_id", "obs_name", 0.5)


@query("D15_sums", "SELECT a.slice_id, a.obs_name, round(sum(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS d FROM spots a JOIN spots b USING (slice_id) GROUP BY ALL")
def d15_sums(spark, sf):
    return T.distance_sums(spots(spark, sf), "slice_id", "obs_name", 64).select("slice_id", "obs_name", F.round("d", 6).alias("d"))


#: Bisection from 0 to 0.64 in at most eight halvings: each radius of that grid is counted, the path is followed from the counts.
@query("N15_radius", """, t AS (SELECT slice_id, obs_name, x, y FROM spots WHERE label = 'L1'), g AS (SELECT k * 0.0025::DOUBLE AS radius, k FROM (SELECT unnest(range(0, 257)) AS k)),
p AS (SELECT t.slice_id, t.obs_name, (t.x - s.x) * (t.x - s.x) + (t.y - s.y) * (t.y - s.y) AS d2 FROM t JOIN spots s USING (slice_id)),
c AS (SELECT slice_id, k, radius, count(*) FILTER (d2 <= radius * radius) / count(DISTINCT obs_name) AS n FROM p, g GROUP BY ALL),
walk AS (WITH RECURSIVE w AS (SELECT DISTINCT slice_id, 0 AS lo, 256 AS hi, CASE WHEN a.n BETWEEN 3 AND 6 THEN 0 WHEN b.n BETWEEN 3 AND 6 THEN 256 END AS hit, a.n > 6 OR b.n < 3 AS none FROM c a JOIN c b USING (slice_id) WHERE a.k = 0 AND b.k = 256
  UNION ALL SELECT w.slice_id, CASE WHEN m.n < 3 THEN (lo + hi) // 2 ELSE lo END, CASE WHEN m.n > 6 THEN (lo + hi) // 2 ELSE hi END, CASE WHEN m.n BETWEEN 3 AND 6 THEN (lo + hi) // 2 END, false FROM w JOIN c m ON m.slice_id = w.slice_id AND m.k = (lo + hi) // 2 WHERE hit IS NULL AND NOT none AND hi - lo > 1) SELECT slice_id, max(hit) AS hit FROM w GROUP BY slice_id)
SELECT slice_id, round(hit * 0.0025, 6) AS radius FROM walk""")
def n15_radius(spark, sf):
    found = T.search_radius(spots(spark, sf), "slice_id", "obs_name", "label", "L1", 0.0, 0.64, 3, 6, max_run=8)
    return found.select("slice_id", F.round("radius", 6).alias("radius"))


@query("F10", f", {_nn('spots', 'spots', 6, _SELF)}, v AS (SELECT n.slice_id, n.obs_name, b.label, count(*) AS n FROM (SELECT slice_id, obs_name, neighbour FROM nn UNION ALL SELECT slice_id, obs_name, obs_name FROM spots) n JOIN spots b ON b.obs_name = n.neighbour GROUP BY ALL), t AS (SELECT obs_name, max(n) AS top, max_by(label, struct_pack(n := n, l := label)) AS best FROM v GROUP BY obs_name) SELECT s.obs_name, CASE WHEN coalesce(v.n, 0) < 3 AND top > 3 THEN best ELSE s.label END AS refined FROM spots s JOIN t USING (obs_name) LEFT JOIN v ON v.obs_name = s.obs_name AND v.label = s.label")
def f10(spark, sf):
    labels = spots(spark, sf).select("slice_id", "obs_name", "label")
    return N.refine(_neighbours(spark, sf), labels, "slice_id", "obs_name", 6).select("obs_name", "refined")


_CENT = "c AS (SELECT slice_id, label AS cluster, avg(x) AS cx, avg(y) AS cy FROM spots GROUP BY ALL)"


@query("N14", f", {_CENT}, q AS (SELECT slice_id, obs_name, cluster, t / sum(t) OVER (PARTITION BY obs_name) AS q FROM (SELECT s.slice_id, obs_name, cluster, 1 / (1 + pow(x - cx, 2) + pow(y - cy, 2)) AS t FROM spots s JOIN c USING (slice_id))), p AS (SELECT *, q * q / sum(q) OVER (PARTITION BY slice_id, cluster) AS s FROM q) SELECT obs_name, cluster, round(q, 6) AS q, round(s / sum(s) OVER (PARTITION BY obs_name), 6) AS p FROM p")
def n14(spark, sf):
    s = spots(spark, sf)
    centroids = s.groupBy("slice_id", F.col("label").alias("cluster")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    return N.soft_assignment(s, centroids, "slice_id", "obs_name").select("obs_name", "cluster", "q", "p")


@query("E13", """, k AS (SELECT *, count(*) OVER (PARTITION BY slice_id, label) AS c FROM real), z AS (SELECT slice_id, obs_name, label, c, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS x, (y - avg(y) OVER w) / stddev_pop(y) OVER w AS y FROM k WINDOW w AS (PARTITION BY slice_id)), f AS (SELECT * FROM z WHERE c > 1),
m AS (SELECT a.slice_id, a.obs_name, a.label = b.label AS same, b.label, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS m FROM f a JOIN f b ON a.slice_id = b.slice_id AND a.obs_name <> b.obs_name GROUP BY ALL), s AS (SELECT slice_id, obs_name, max(m) FILTER (same) AS a, min(m) FILTER (NOT same) AS b FROM m GROUP BY ALL) SELECT slice_id, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM s WHERE b IS NOT NULL GROUP BY slice_id""")
def e13(spark, sf):
    return N.silhouette(real(spark, sf), "slice_id", "obs_name", "label")


@query("E9", f", {_GRID} SELECT slice_id, cell AS region, count(*) FILTER (source = 'real') AS n_real, count(*) FILTER (source = 'synthetic') AS n_synthetic, round(count(*) FILTER (source = 'synthetic') / nullif(count(*) FILTER (source = 'real'), 0), 6) AS ratio FROM grid GROUP BY ALL")
def e9(spark, sf):
    g = P.grid_regions(spots(spark, sf), "slice_id", 3).withColumn("region", F.regexp_extract("region", "_grid_(.*)$", 1))
    c = g.groupBy("slice_id", "region").agg(F.count_if(F.col("source") == "real").alias("n_real"), F.count_if(F.col("source") == "synthetic").alias("n_synthetic"))
    return c.withColumn("ratio", F.round(F.try_divide("n_synthetic", "n_real"), 6))


@query("E10", f", {_GRID} SELECT cell AS region, count(DISTINCT slice_id) AS n_slices, round(avg(r), 6) AS mean_real FROM (SELECT slice_id, cell, count(*) FILTER (source = 'real') AS r FROM grid GROUP BY ALL) GROUP BY cell")
def e10(spark, sf):
    return e9(spark, sf).groupBy("region").agg(F.countDistinct("slice_id").alias("n_slices"), F.round(F.avg("n_real"), 6).alias("mean_real"))


@query("G5", f", {_GRID} SELECT slice_id, cell AS region, ratio FROM (SELECT slice_id, cell, round(count(*) FILTER (source = 'synthetic') / nullif(count(*) FILTER (source = 'real'), 0), 6) AS ratio FROM grid GROUP BY ALL) WHERE ratio IS NOT NULL QUALIFY row_number() OVER (PARTITION BY slice_id ORDER BY ratio DESC, cell) = 1")
def g5(spark, sf):
    from ..operators.ranking import top_k

    return top_k(e9(spark, sf).where("ratio is not null"), ["slice_id"], [F.desc("ratio"), F.col("region")]).select("slice_id", "region", "ratio")


@query("G10", f", c AS (SELECT slice_id, other, count(*) AS n FROM ({_NEAR}) WHERE label = 'L1' AND other <> 'L1' GROUP BY ALL) SELECT slice_id, other, n FROM c QUALIFY row_number() OVER (PARTITION BY slice_id ORDER BY n DESC, other) <= 3")
def g10(spark, sf):
    s = spots(spark, sf)
    near = N.radius_join(s.where("label = 'L1'"), s, "slice_id", "obs_name", 0.05)
    other = near.join(s.select("slice_id", F.col("obs_name").alias("neighbour"), F.col("label").alias("other")), ["slice_id", "neighbour"]).where("other != 'L1'").groupBy("slice_id", "other").agg(F.count("*").alias("n"))
    return other.withColumn("_k", F.row_number().over(W.partitionBy("slice_id").orderBy(F.desc("n"), "other"))).where("_k <= 3").drop("_k")


@query("E39a", "SELECT obs_name, round((m - avg(m) OVER w) / stddev_pop(m) OVER w * greatest(stddev_pop(x) OVER w, stddev_pop(y) OVER w), 6) AS z FROM (SELECT *, list_sum(vec) / len(vec) AS m FROM spots) WINDOW w AS (PARTITION BY slice_id)")
def e39a(spark, sf):
    """Third axis of the distance: the standardised mean of the vector on the scale of the wider coordinate."""
    w = W.partitionBy("slice_id")
    s = spots(spark, sf).withColumn("m", F.aggregate("vec", F.lit(0.0), lambda a, v: a + v) / F.size("vec"))
    z = (F.col("m") - F.avg("m").over(w)) / F.stddev_pop("m").over(w) * F.greatest(F.stddev_pop("x").over(w), F.stddev_pop("y").over(w))
    return s.select("obs_name", F.round(z, 6).alias("z"))
