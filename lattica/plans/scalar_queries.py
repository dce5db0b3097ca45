"""Queries for the scalar functions."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import paradigm
from .registry import expr, predictions, query, spots, table


@query("J1", "SELECT doc_id, coalesce(nullif(trim(regexp_replace(text, '[^A-Za-z0-9_.-]+', '_', 'g'), '_'), ''), 'value') AS token FROM documents")
def j1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.safe_token("text").alias("token"))


_G = "regexp_replace(regexp_replace(printf('%.6f', {0}::DOUBLE), '0+$', ''), '\\.$', '')"


@query("J2", f"SELECT obs_name, concat_ws('_', paradigm, 'ratio' || {_G.format('ratio')}, 'alpha' || {_G.format('alpha')}) AS variant_id, replace({_G.format('alpha')}, '.', 'p') AS tag FROM pred")
def j2(spark, sf):
    return predictions(spark, sf).select("obs_name", S.variant_id(F.col("paradigm"), F.col("ratio"), F.col("alpha")).alias("variant_id"), S.point_free(F.col("alpha")).alias("tag"))


@query("J3", f"SELECT o_orderkey, 'pool_' || {_G.format('(o_orderkey % 80) / 4')} || 'x' AS tag FROM orders")
def j3(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", S.pool_tag(F.col("o_orderkey") % 80 / 4).alias("tag"))


@query("J4", "SELECT l_orderkey, l_linenumber, 'fraction' || round_even(100 * l_discount::DOUBLE, 0)::INT AS tag FROM lineitem")
def j4(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.fraction_tag(F.col("l_discount").cast("double")).alias("tag"))


@query("J5", "SELECT obs_name, 42 + ('0x' || substr(sha256(concat_ws('||', model, slice_id, coalesce(seed::VARCHAR, 'None'), coalesce(classifier, 'None'))), 1, 8))::BIGINT % 100000 AS seed FROM pred")
def j5(spark, sf):
    return predictions(spark, sf).select("obs_name", S.stable_seed(42, F.col("model"), F.col("slice_id"), F.col("seed"), F.col("classifier")).alias("seed"))


#: CRC-32 byte by byte, with its table made from the polynomial; labels are ASCII.
@query("J6", """, tab AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t)
SELECT obs_name, xor(list_reduce(list_concat([4294967295], list_transform(string_split(label, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS seed FROM spots, tab""")
def j6(spark, sf):
    return spots(spark, sf).select("obs_name", S.label_seed(F.col("label")).alias("seed"))


@query("J7", "SELECT p_partkey, CASE WHEN upper(trim(p_type)) LIKE '%BRASS%' THEN 'Cancer' WHEN upper(trim(p_type)) LIKE '%STEEL%' THEN 'Healthy' WHEN upper(trim(p_type)) LIKE '%TIN%' THEN 'Diseased' ELSE 'Other' END AS label FROM part")
def j7(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.disease_label(F.col("p_type"), {"brass": "Cancer", "steel": "Healthy", "tin": "Diseased"}).alias("label"))


@query("J8", "SELECT page_id, coalesce(nullif(regexp_extract(url, '\\.example\\.(org)', 1), ''), nullif(regexp_extract(url, '^(https?)', 1), ''), 'unknown') AS dataset FROM pages")
def j8(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select("page_id", S.first_known(F.regexp_extract(url, r"\.example\.(org)", 1), F.regexp_extract(url, "^(https?)", 1), default="unknown").alias("dataset"))


@query("J9", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'spatial_cluster' WHEN source <> 'src1' THEN 'sample_disease_prediction' WHEN lang = 'fr' THEN 'supervised_low_label' ELSE 'cross_slice_generalization' END AS task FROM documents""")
def j9(spark, sf):
    d = table(spark, sf, "documents")
    mode = F.when(F.col("lang") == "en", "unsupervised").when(F.col("lang") == "fr", "low_label").otherwise("supervised")
    return d.select("doc_id", S.task_name(F.lit(""), mode, F.when(F.col("source") == "src1", "DLPFC").otherwise("Brain")).alias("task"))


_BIN = "CASE WHEN len({e}) < 3 THEN 0 ELSE len(list_filter({e}[2:len({e}) - 1], lambda e: e <= {v})) END"
@query("J10", f"SELECT obs_name, ({_BIN.format(e='ex', v='x')})::INT AS bin FROM spots JOIN (SELECT slice_id, list_sort(list_distinct(quantile_cont(x, [0, 1/3, 2/3, 1]))) AS ex FROM spots GROUP BY slice_id) USING (slice_id)")
def j10(spark, sf):
    regions = paradigm.quantile_regions(spots(spark, sf), ["slice_id"])
    return regions.select("obs_name", F.substring_index(F.substring("region", 2, 9), "_", 1).cast("int").alias("bin"))


@query("J14", "SELECT spot, gene_idx, round(ln(1 + value * 1e4 / sum(value) OVER (PARTITION BY spot)), 6) AS v FROM expr")
def j14(spark, sf):
    return expr(spark, sf).select("spot", "gene_idx", F.round(S.log_normalised(F.col("value"), F.sum("value").over(W.partitionBy("spot"))), 6).alias("v"))


@query("J21", "SELECT event_id, round(1 / (1 + exp(-0.1 * (value - 50))), 6) AS p FROM events")
def j21(spark, sf):
    return table(spark, sf, "events").select("event_id", F.round(S.logistic(F.col("value"), 50.0, 0.1), 6).alias("p"))


@query("J22", "SELECT event_id, greatest(round_even(CASE WHEN event_id % 7 = 0 THEN 0 ELSE value - 20 END, 0), 0)::BIGINT AS n FROM events")
def j22(spark, sf):
    dirty = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 20)
    return table(spark, sf, "events").select("event_id", S.counts_of(dirty).alias("n"))


@query("J25", "SELECT k::INT AS step, round(0.001 + (0.2 - 0.001) * k / 99, 9) AS linear, round(least(1 - pow(cos(((k + 1) / 100 + 0.008) / 1.008 * pi() / 2), 2) / pow(cos((k / 100 + 0.008) / 1.008 * pi() / 2), 2), 0.999), 9) AS cosine FROM range(100) t(k)")
def j25(spark, sf):
    rows = [(k, round(a, 9), round(b, 9)) for k, (a, b) in enumerate(zip(S.linear_betas(100), S.cosine_betas(100)))]
    return spark.createDataFrame(rows, "step int, linear double, cosine double")


@query("J26", "SELECT obs_name, (dense_rank() OVER (ORDER BY label) - 1)::INT AS code FROM spots")
def j26(spark, sf):
    s = spots(spark, sf)
    codes = s.select("label").distinct().withColumn("code", F.row_number().over(W.orderBy("label")) - 1)
    return s.join(F.broadcast(codes) if codes.count() < 100_000 else codes, "label").select("obs_name", F.col("code").cast("int").alias("code"))


@query("J27", "SELECT event_id, list_sum(list_filter(list_transform(string_split(user_id || ', x,' || event_id || ',', ','), lambda x: try_cast(trim(x) AS DOUBLE)), lambda x: x IS NOT NULL)) AS total FROM events")
def j27(spark, sf):
    text = F.concat(F.col("user_id").cast("string"), F.lit(", x,"), F.col("event_id").cast("string"), F.lit(","))
    return table(spark, sf, "events").select("event_id", F.aggregate(S.number_list(text), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("J31", "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def j31(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("J32", "SELECT f AS family, r AS ratio, a AS alpha, concat_ws('_', f, 'ratio' || r::INT, CASE WHEN a = 0.5 THEN 'alpha0.5' WHEN a IS NOT NULL THEN 'alpha' || a::INT END) AS variant_id FROM (SELECT 'real_synthetic' AS f, unnest([1.0, 2.0, 5.0]::DOUBLE[]) AS r, NULL::DOUBLE AS a UNION ALL SELECT 'weighted_erm', r, a FROM (SELECT unnest([1.0, 2.0]::DOUBLE[]) AS r), (SELECT unnest([0.0, 0.5, 1.0]::DOUBLE[]) AS a) UNION ALL SELECT 'real_baseline', NULL, NULL)")
def j32(spark, sf):
    grid = paradigm.variant_grid(spark, {"real_baseline": ([], []), "real_synthetic": ([1.0, 2.0, 5.0], []), "weighted_erm": ([1.0, 2.0], [0.0, 0.5, 1.0])})
    return grid.withColumn("variant_id", S.variant_id(F.col("family"), F.col("ratio"), F.col("alpha")))


@query("J33", "SELECT m AS model, r AS ratio FROM (SELECT 'a' AS m, unnest(range(3, 8)) AS r UNION SELECT 'b', unnest(range(10, 12)))")
def j33(spark, sf):
    windows = spark.createDataFrame([("a", "lr", "3,4,5,6,7"), ("b", "lr", "10, 11,x")], "model string, classifier string, weighted_ratio_window string")
    return windows.select("model", F.explode(S.number_list(F.col("weighted_ratio_window"))).alias("ratio")).select("model", F.col("ratio").cast("long").alias("ratio")).distinct()


@query("J34", "SELECT o_orderkey, 42 + (o_orderkey % 5) * 1009 + (o_orderkey % 12) * 31 AS package_seed, 42 + (o_orderkey % 12) * 997 AS fit_seed, 42 + (o_orderkey % 12) * 1009 + 17 AS draw_seed FROM orders")
def j34(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", (42 + k % 5 * 1009 + k % 12 * 31).alias("package_seed"), (42 + k % 12 * 997).alias("fit_seed"), (42 + k % 12 * 1009 + 17).alias("draw_seed"))


@query("J35", "SELECT doc_id, try_cast(trim(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN ' ' || n_chars ELSE lang END) AS DOUBLE) AS v FROM documents")
def j35(spark, sf):
    d = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", S.to_number(F.when(d == 0, "").when(d == 1, F.concat(F.lit(" "), F.col("n_chars").cast("string"))).otherwise(F.col("lang"))).alias("v"))


@query("J36", "SELECT l_suppkey, round(greatest(coalesce(var_samp(l_quantity::DOUBLE), 0), 1e-8), 6) AS v FROM lineitem GROUP BY ALL")
def j36(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(S.variance_floor(F.col("l_quantity").cast("double")), 6).alias("v"))


@query("J24", "SELECT obs_name, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 6) AS zx, round((y - avg(y) OVER w) / stddev_pop(y) OVER w, 6) AS zy FROM spots WINDOW w AS (PARTITION BY slice_id)")
def j24(spark, sf):
    w = W.partitionBy("slice_id")
    z = lambda c: F.round((F.col(c) - F.avg(c).over(w)) / F.stddev_pop(c).over(w), 6)
    return spots(spark, sf).select("obs_name", z("x").alias("zx"), z("y").alias("zy"))
