"""An incremental monitor of prediction metrics over an event stream (an extension), and bounded-memory batch runs."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_confusion(stream: DataFrame, time: str, size: str, late: str, by: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Confusion counts per tumbling window; rows later than the watermark are dropped and state is let go. Works on batches too."""
    rows = stream.withWatermark(time, late) if stream.isStreaming else stream
    return rows.groupBy(F.window(time, size).alias("w"), *by, truth, pred).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, truth, pred, "n")


def run_packages(packages: Iterable[dict], build: Callable[..., DataFrame], sink: Callable[[DataFrame, dict], None]) -> int:
    """Builds, sinks and forgets one package at a time; a lazily built DataFrame holds no rows on the driver."""
    n = 0
    for parameters in packages:
        sink(build(**parameters), parameters)
        n += 1
    return n
