"""Places of rows in a total order, without a window that puts all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.bundle import stored

#: Ranges that rows are dealt over; the table of offsets has a row for each.
RANGES = 64


def numbered(df: DataFrame, order: list[str], out: str, ranges: int = RANGES) -> DataFrame:
    """df with `out`, the place (from 0) of each row in the ascending order of the columns.

    Rows are dealt over ranges of the order and written with the number of their range; a range's first place is the number of
    rows in those before it. order should end in a unique key: then a frequent value is split over ranges too, and places are unique
    in one way only. Nulls come first.
    """
    dealt = stored(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # a row for each range
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("_range", before.alias("_first"))
    at = F.row_number().over(W.partitionBy("_range").orderBy(*order)) - 1
    return dealt.withColumn("_at", at).join(F.broadcast(firsts), "_range").withColumn(out, F.col("_first") + F.col("_at")).drop("_range", "_at", "_first")


def sorted_pairs(a: DataFrame, b: DataFrame, value: str, key: str) -> DataFrame:
    """(a, b): the values of both sides paired by place, the least with the least; what the longer side has more of is left out."""
    one = numbered(a.select(value, key), [value, key], "_place").select("_place", F.col(value).alias("a"))
    two = numbered(b.select(value, key), [value, key], "_place").select("_place", F.col(value).alias("b"))
    return one.join(two, "_place").select("a", "b")


def adjusted(df: DataFrame, p: str, key: str, out: str = "p_adjusted") -> DataFrame:
    """df with Benjamini-Hochberg's adjustment of the column p: the least of p * n / rank over this and all later places, at most 1.

    The least of each range of places is taken first, so no task sees more than a range and a row for each other range.
    """
    n = df.count()
    placed = numbered(df, [p, key], "_place").withColumn("_raw", F.col(p) * n / (F.col("_place") + 1)).withColumn("_part", F.floor(F.col("_place") * RANGES / F.lit(max(n, 1))))
    later = placed.groupBy("_part").agg(F.min("_raw").alias("_least"))
    later = later.select("_part", F.min("_least").over(W.orderBy(F.desc("_part")).rowsBetween(W.unboundedPreceding, -1)).alias("_later"))
    here = F.min("_raw").over(W.partitionBy("_part").orderBy(F.desc("_place")).rowsBetween(W.unboundedPreceding, W.currentRow))
    return placed.join(F.broadcast(later), "_part").withColumn(out, F.least(here, "_later", F.lit(1.0))).drop("_place", "_raw", "_part", "_later")
