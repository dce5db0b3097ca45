"""Evaluation of prediction files as they come: each file is measured once, its result is flushed at once, and a run goes on where it ended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.package import read_packages, write_package

_FILES = "path string, modificationTime timestamp, length long, content binary"


def _measured(files: DataFrame, fields: str, reference: Callable[[Column], Column], references: DataFrame, measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A row for each file (path, content): its measures and status ok, or status skipped or failed and the reason."""
    schema = ", ".join([fields, "_bad string"])
    header = ",".join(f.split()[0] for f in fields.split(", "))
    lines = F.split(F.decode("content", "UTF-8"), "\r?\n")
    files = files.select("path", lines.alias("lines"), reference(F.col("path")).alias("reference"))
    parsed = files.select("path", F.posexplode("lines").alias("at", "line")).where("at > 0 and line != ''").select("path", "at", F.from_csv("line", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("r")).select("path", "at", "r.*")
    lines_of = parsed.groupBy("path").agg(F.count("*").alias("_n"), F.min(F.when(F.col("_bad").isNotNull(), F.col("at"))).alias("_wrong"))
    known = references.select(F.col("reference"), F.lit(True).alias("_known")).distinct()
    head = F.get("lines", F.lit(0))
    status = files.join(known, "reference", "left").join(lines_of, "path", "left").select(
        "path",
        "reference",
        F.when(F.col("_known").isNull(), "missing_reference").alias("_skip"),
        F.when(head != header, F.concat(F.lit("header is not "), F.lit(header))).when(F.coalesce("_n", F.lit(0)) == 0, "no rows").when(F.col("_wrong").isNotNull(), F.concat(F.lit("line "), (F.col("_wrong") + 1).cast("string"), F.lit(" is malformed"))).alias("_fail"),
    )
    good = status.where("_skip is null and _fail is null").select("path")
    measures = measure(parsed.drop("at", "_bad").join(good, "path", "left_semi"))
    flag = F.when(F.col("_skip").isNotNull(), "skipped").when(F.col("_fail").isNotNull(), "failed").otherwise("ok")
    return status.join(measures, "path", "left").select("path", "reference", flag.alias("status"), F.coalesce("_skip", "_fail", F.lit("")).alias("reason"), *(c for c in measures.columns if c != "path"))


def evaluate_files(spark: SparkSession, root: str, out: str, checkpoint: str, fields: str, reference: Callable[[Column], Column], references: DataFrame, measure: Callable[[DataFrame], DataFrame], files_at_once: int = 100, glob: str = "*.csv", most: int | None = None) -> int:
    """Measures the CSV files below root that were not yet measured; how many batches it flushed.

    fields: the columns that a file must have, in order; reference gives what a path refers to, and a file is skipped unless `references` has it.
    measure: (path, fields) -> one row of measures for each path. A file without rows, with another header or with a malformed line is
    failed, with the reason; the others of its batch are not touched. (Spark's readers pass over files of no bytes, so these get no row.) Each batch is a package named by its number, so one that is
    repeated after a crash takes the place of its own earlier attempt. most: batches after which the run ends (the next run goes on).
    """
    flushed = []

    class Enough(Exception):
        pass

    def flush(batch: DataFrame, number: int) -> None:
        if most is not None and len(flushed) >= most:
            raise Enough
        write_package(batch.sparkSession, f"{out}/{number:010d}", {"rows": _measured(batch.select("path", "content"), fields, reference, references, measure)}, {"batch": number})
        flushed.append(number)

    stream = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_at_once).load(root)
    run = stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        run.awaitTermination()
    except Exception:
        if most is None or len(flushed) < most:
            raise
    return len(flushed)


def evaluations(spark: SparkSession, out: str) -> DataFrame:
    """All rows flushed to out so far, a file once."""
    found = read_packages(spark, f"{out}/*", "rows")
    if found is None:
        raise FileNotFoundError(f"nothing was flushed to {out}")
    return found
