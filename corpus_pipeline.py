"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, written as Parquet in the session's shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontam, line_dedup, packing, quality_net, simhash
from lattica.llm.common import cut, free_name, fresh_path, table


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Null and empty texts are scored like others; repeated rows share their fate."""
    model = quality_net.fit(docs, table(spark, sf_dir, "labels"))
    return quality_net.accepted(docs, model)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines one stays; documents of which no word is left go. n_chars follows the text. Null and blank texts have no lines and stay;
    of repeated rows the first keeps the lines that stay."""
    dropped = free_name(docs, "dropped")
    lines = line_dedup.deduplicated(docs, count_as=dropped)
    gone = (F.col(dropped) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    n_chars = F.when(F.col(dropped) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return lines.where(~F.coalesce(gone, F.lit(False))).select(*(n_chars if c == "n_chars" else f"`{c}`" for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least doc_id stays; of repeats of its row, one."""
    row = free_name(docs, "row")
    stay = cut(simhash.near_duplicates(docs).where("first").groupBy(F.col("row").alias(row)).agg(F.count("*").alias("n")))
    kept = docs.withColumn(row, simhash.row_key()).join(stay.select(row), row, "left_semi")
    if stay.where("n > 1").limit(1).count():
        kept = kept.dropDuplicates([row])
    return kept.select(*(f"`{c}`" for c in docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go. Null and blank texts hold none and stay; repeated rows share their fate."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes. Null and blank texts are an end token alone; repeated rows are packed as often as they occur."""
    return packing.packed(docs)


STAGES = [("classify", classify), ("dedup_lines", dedup_lines), ("dedup_documents", dedup_documents), ("decontaminate", decontaminate), ("pack", pack)]

#: Trained models, fingerprints and fuzzy line groups are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to the table documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := fresh_path(spark, name))
            docs = spark.read.parquet(path)
    return docs
