"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_names, decontam, divergence, langid, licenses, line_dedup, packing, pii, quality_net, quality_rules, simhash, token_files, whitening
from .common import table


def op1_langid_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op3_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_js_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf_dir, "documents"))


def op5_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).drop("row", "first")


def op9_decontam_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("spans")


def op10_quality_random_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_net.scored(docs, quality_net.fit(docs, table(spark, sf_dir, "labels")))


def op6_token_arrow_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digests(table(spark, sf_dir, "documents"))


def op7_license_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(table(spark, sf_dir, "documents"))


def op8_line_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening_lanczos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audited(table(spark, sf_dir, "documents"))


def op13_exact_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_names.deduplicated(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {"op4_quality_js_divergence": quality_rules.ORACLE, "op12_source_divergence": divergence.ORACLE, "op13_exact_block_names": block_names.ORACLE}
