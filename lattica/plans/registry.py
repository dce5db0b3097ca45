"""Registered queries: a Spark plan over the test tables, and where possible the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {BASE} {sql}"
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spots with coordinates and vectors, even ids real and odd ones synthetic, in four slices."""
    i = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.concat(F.lit("spot"), i).alias("obs_name"),
        i.alias("pos"),
        F.concat(F.lit("s"), F.floor(i / 2) % 4).alias("slice_id"),
        F.concat(F.lit("L"), F.col("label")).alias("label"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
        F.when(i % 2 == 0, "real").otherwise("synthetic").alias("source"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


def real(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots(spark, sf_dir).where("source = 'real'")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spots(spark, sf_dir).where("source = 'synthetic'")


def expr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long expression: spot, gene_idx, value."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 400).alias("spot"), (F.col("l_partkey") % 60).alias("gene_idx")).agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    label = lambda c: F.concat(F.lit("L"), c)
    base = u % 5 == 0
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("o"), e).alias("obs_name"),
        F.concat(F.lit("s"), u % 4).alias("slice_id"),
        F.col("event_type").alias("model"),
        (u % 3).cast("int").alias("seed"),
        F.when(base, "baseline").otherwise("global").alias("paradigm"),
        F.when(~base, (u % 5).cast("double")).alias("ratio"),
        F.when(~base & (e % 2 == 0), F.lit(0.5)).alias("alpha"),
        F.when(e % 4 == 0, "lr").otherwise("mlp").alias("classifier"),
        label(e % 5).alias("y_true"),
        label(F.when(e % 3 == 0, (e + u) % 5).otherwise(e % 5)).alias("y_pred"),
        (F.floor(F.col("value")) % 20 / 20).alias("score"),
    )


#: The same tables in DuckDB SQL.
BASE = """
spots AS (SELECT 'spot' || vec_id AS obs_name, vec_id AS pos, 's' || ((vec_id // 2) % 4) AS slice_id, 'L' || label AS label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y,
  CASE WHEN vec_id % 2 = 0 THEN 'real' ELSE 'synthetic' END AS source, embedding::DOUBLE[] AS vec FROM embeddings),
real AS (SELECT * FROM spots WHERE source = 'real'),
pool AS (SELECT * FROM spots WHERE source = 'synthetic'),
expr AS (SELECT l_orderkey % 400 AS spot, l_partkey % 60 AS gene_idx, sum(l_quantity::DOUBLE) AS value FROM lineitem GROUP BY ALL),
pred AS (SELECT 'o' || event_id AS obs_name, 's' || (user_id % 4) AS slice_id, event_type AS model, (user_id % 3)::INT AS seed,
  CASE WHEN user_id % 5 = 0 THEN 'baseline' ELSE 'global' END AS paradigm, CASE WHEN user_id % 5 <> 0 THEN (user_id % 5)::DOUBLE END AS ratio,
  CASE WHEN user_id % 5 <> 0 AND event_id % 2 = 0 THEN 0.5::DOUBLE END AS alpha, CASE WHEN event_id % 4 = 0 THEN 'lr' ELSE 'mlp' END AS classifier,
  'L' || (event_id % 5) AS y_true, 'L' || (CASE WHEN event_id % 3 = 0 THEN (event_id + user_id) % 5 ELSE event_id % 5 END) AS y_pred, (floor(value)::BIGINT % 20) / 20 AS score FROM events)
"""
