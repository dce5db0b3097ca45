"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators of words: ASCII space and the control characters from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
#: Broadcast a lookup table only up to so many rows (tens of MB); beyond that it is shuffled.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; one of our own only where it names none and all runs on one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "/tmp/lattica-checkpoints"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/lattica-{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    out = df.checkpoint(eager=True)
    # shuffle files of what is written are let go when the driver collects its garbage, else up to half an hour later
    context._jvm.System.gc()
    return out


def stored(df: DataFrame, what: str, **options: str) -> DataFrame:
    """df, written as a table of the shared folder and read from it: like cut(), but later steps read only the columns they need."""
    df.write.options(**options).parquet(path := fresh_path(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df of so many counted rows, to be broadcast only where these are few (tens of MB); beyond that it is shuffled."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken or name in ("doc_id", "text"):
        name += "_"
    return name


def words_of(text):
    """Array of the words of a text column; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")
