"""Whitening of embeddings: leading eigenvectors of their covariance by block Lanczos, which never forms the covariance.

Every step multiplies a block of directions by the covariance in one pass over the rows: each task adds up its part of X'(XB), and only
d x b sums leave it. The basis, at most d x d, and the small projected matrix are all that the driver holds.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Components that are asked for.
COMPONENTS = 32
#: Steps end when no wanted pair's residual is above this share of the largest eigenvalue.
TOLERANCE = 1e-13
#: Directions of less than this share of the largest eigenvalue are rounding noise, not components.
NOISE = 1e-11
#: A new direction of which less than this share is left beside the basis has broken down and is drawn anew.
BREAKDOWN = 1e-10


@dataclass
class Whitening:
    """n fitted rows, sums and trace (of the covariance), eigenvalues in falling order and unit eigenvectors as columns."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    passes: int


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x): x = floor(64 c) + 1000000 of each entry c, for the rows whose vector is not null, without null and non-finite
    entries, and as long as the longest of these (a shorter one lacks entries). An x that no long can hold raises an error."""
    c = F.col(vector).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = F.transform(c, lambda v: F.when(F.abs(v) < 2.0**56, F.floor(v * 64)).otherwise(F.raise_error(F.lit("an entry is too large for a long"))).cast("long") + 1_000_000)
    kept = stored(vectors.where(F.col(vector).isNotNull()).where(fine).select(F.col(key).alias("key"), x.alias("x")), "vectors")
    d = kept.agg(F.max(F.size("x"))).first()[0]
    return kept.where(F.size("x") == F.lit(d or 0))


def _summed(rows: DataFrame, job, size: int) -> np.ndarray:
    """The sum over tasks of the vectors of `size` doubles that job makes of each matrix of rows; added up by Spark, entry by entry."""

    def run(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0)
                total += job(x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], ["at", "v"])

    found = rows.select("x").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()  # d x b numbers
    out = np.zeros(size)
    out[found["at"].to_numpy()] = found["v"].to_numpy()
    return out


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n; the difference is taken in whole numbers, so nothing is lost of small deviations from large means."""
    return (n * x - sums) / n


def covariance_times(rows: DataFrame, n: int, sums: list[int], block: np.ndarray) -> np.ndarray:
    """The covariance (divisor n) of the rows' x, times a block of directions."""
    s = np.array(sums, dtype=np.int64)

    def job(x):
        z = _centred(x, n, s)
        return (z.T @ (z @ block)).ravel()

    return _summed(rows, job, block.size).reshape(block.shape) / n


def _orthogonal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit directions beside the basis that span what is left of the block; a direction that breaks down is replaced by a random one."""
    out = basis
    for column in block.T:
        for _ in range(64):
            length = np.linalg.norm(column)
            if length > 0:
                v = column / length
                for _ in range(3):
                    v = v - out @ (out.T @ v)
                if (left := np.linalg.norm(v)) > BREAKDOWN:
                    v = v / left
                    v = v - out @ (out.T @ v)
                    out = np.column_stack([out, v / np.linalg.norm(v)])
                    break
            column = rng.standard_normal(len(column))
        if out.shape[1] == len(out):
            break
    return out[:, basis.shape[1] :]


def fit(rows: DataFrame, components: int = COMPONENTS, seed: int = 5, multiply=covariance_times) -> Whitening:
    """Leading eigenpairs of the covariance of x over all rows of `usable`.

    Blocks are as wide as the number of components, so that an eigenvalue may repeat as often; a block that breaks down goes on with
    random directions. Ritz pairs come from the whole basis, and their residuals from the products themselves. The basis may grow to all d
    dimensions, where it is exact.
    """
    size = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()
    n, d, largest = int(size[0]), int(size[1] or 0), int(size[2] or 0)
    if not n or not d:
        return Whitening(n, [0] * d, 0.0, np.zeros(0), np.zeros((d, 0)), 0)
    if n * largest >= 2**62:
        raise ValueError(f"{n} rows of entries up to {largest} are beyond whole numbers of 64 bits")
    parts = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).collect()  # d rows
    sums = [int(r["s"]) for r in sorted(parts)]
    total = rows.agg(F.sum(deviation(n, sums))).first()[0]
    trace = float(total) / n**3
    if total == 0:
        return Whitening(n, sums, 0.0, np.zeros(0), np.zeros((d, 0)), 0)
    k = min(components, d)
    rng = np.random.default_rng(seed)
    basis, products = np.zeros((d, 0)), np.zeros((d, 0))
    block, passes, best = rng.standard_normal((d, k)), 0, np.inf
    while True:
        new = _orthogonal(block, basis, rng)
        product = multiply(rows, n, sums, new)
        passes += 1
        basis, products = np.column_stack([basis, new]), np.column_stack([products, product])
        small = basis.T @ products
        values, mix = np.linalg.eigh((small + small.T) / 2)
        values, mix = values[::-1], mix[:, ::-1]
        residuals = np.linalg.norm(products @ mix[:, :k] - basis @ mix[:, :k] * values[:k], axis=0).max() / values[0]
        # rounding of the sums keeps residuals above some level: there no further step makes them less
        if basis.shape[1] == d or residuals <= TOLERANCE or (residuals < 1e-11 and residuals > best / 2):
            break
        best = min(best, residuals)
        block = product
    keep = values[:k] > values[0] * NOISE
    vectors = basis @ mix[:, :k][:, keep]
    return Whitening(n, sums, trace, values[:k][keep], vectors / np.linalg.norm(vectors, axis=0), passes)


def deviation(n: int, sums: list[int]):
    """Column: the sum over dimensions of (n x - S)^2, exact as decimal(38, 0)."""
    s = F.array(*(F.lit(v) for v in sums))
    square = lambda x, m: (F.lit(n).cast("long") * x - m).cast("decimal(19,0)") * (F.lit(n).cast("long") * x - m).cast("decimal(19,0)")
    return F.aggregate(F.zip_with("x", s, square), F.lit(0).cast("decimal(38,0)"), lambda a, v: (a + v).cast("decimal(38,0)"))


def transformed(rows: DataFrame, model: Whitening) -> DataFrame:
    """rows with `z`, the whitened coordinates: x - S / n on each component, over the root of its eigenvalue."""
    n, s, project = model.n, np.array(model.sums, dtype=np.int64), model.vectors / np.sqrt(model.values)
    names = rows.columns

    def run(batches):
        for batch in batches:
            x = batch.column(names.index("x")).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            z = (_centred(x, n, s) @ project).ravel() if batch.num_rows else np.zeros(0)
            offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(model.values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(z))], [*names, "z"])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, z array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows, measured on the rows themselves, less the identity."""
    n, s, project, k = model.n, np.array(model.sums, dtype=np.int64), model.vectors / np.sqrt(model.values), len(model.values)

    def job(x):
        z = _centred(x, n, s) @ project
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    total = _summed(rows, job, k + k * k) / n
    mean, second = total[:k], total[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each usable row and each component up to `components`.

    Rows with a null vector, or one with null, non-finite or missing entries, are dropped; repeated rows and null keys count and are returned
    like others; extra columns are ignored. Components whose eigenvalue is no more than rounding noise (constant or dependent dimensions)
    are left out, so a table of equal rows, of one row or of none gives none. Eigenvalues that tie give some orthonormal basis of their space,
    the same for all rows. deviation is null where a long cannot hold it (the trace is summed in decimals and stays exact).
    """
    rows = usable(vectors, key, vector)
    model = fit(rows, components)
    fields = "component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not len(model.values):
        kind = dict(vectors.dtypes)[key]
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kind}, {fields}")
    error = identity_error(rows, model)
    shares = F.array(*(F.lit(float(v) / model.trace) for v in model.values))
    dev = deviation(model.n, model.sums)
    long = F.when(dev < F.lit(2**63 - 1).cast("decimal(38,0)"), dev).cast("long")
    # once for each row, before these become a row for each component
    whole = transformed(rows.select("key", "x", long.alias("deviation")), model).select("key", "deviation", F.posexplode("z").alias("at", "whitened"))
    return whole.select(F.col("key").alias(key), (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"))
