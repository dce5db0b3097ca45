"""Tables that compare methods over slices and seeds, and with a baseline method."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _means(runs: DataFrame, slice_: str, method: str, metrics: list[str]) -> DataFrame:
    return runs.groupBy(slice_, method).agg(*(F.avg(m).alias(m) for m in metrics))


def by_slice(runs: DataFrame, slice_: str, method: str, metrics: list[str], places: int = 4) -> DataFrame:
    """(slice, method, metrics): means over the runs of a method on a slice."""
    return _means(runs, slice_, method, metrics).select(slice_, method, *(F.round(m, places).alias(m) for m in metrics))


def against(runs: DataFrame, slice_: str, method: str, metrics: list[str], baseline: str, places: int = 4) -> DataFrame:
    """For each method the mean and deviation of each metric over all runs, and of its gains over the baseline's mean on the same slice.

    Gains are rounded by slice first. The baseline itself, and a method that shares no slice with it, has null gains; a single run or slice has no deviation.
    """
    spread = lambda m, name, sd: [F.round(F.avg(m), places).alias(name), F.round(F.stddev_samp(m), places).alias(sd)]
    overall = runs.groupBy(method).agg(*(c for m in metrics for c in spread(m, f"{m}_mean", f"{m}_std")))
    means = _means(runs, slice_, method, metrics)
    base = means.where(F.col(method) == baseline).select(slice_, *(F.col(m).alias(f"_{m}") for m in metrics))
    gains = means.where(F.col(method) != baseline).join(base, slice_).select(method, *(F.round(F.col(m) - F.col(f"_{m}"), places).alias(m) for m in metrics))
    return overall.join(gains.groupBy(method).agg(*(c for m in metrics for c in spread(m, f"{m}_delta", f"{m}_delta_std"))), method, "left")
