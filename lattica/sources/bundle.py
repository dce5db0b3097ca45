"""Readers and writers of the typed tables; all paths go through Spark's file systems."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREDICTIONS = "obs_name string, slice_id string, y_true string, y_pred string, score double"


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder under the shared folder that the session names; a local one only where it names none and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(root or '/tmp/lattica-checkpoints').rstrip('/')}/lattica-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, computed once and written to the shared folder: a lost executor costs no recomputation, later steps read only their columns."""
    df.write.parquet(path := scratch(df.sparkSession, what))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_bundle(tables: dict[str, DataFrame], path: str, partition_by: dict[str, str] | None = None, mode: str = "error") -> None:
    for name, df in tables.items():
        writer = df.write.mode(mode)
        by = (partition_by or {}).get(name)
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}")


def read_bundle(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def write_predictions(df: DataFrame, path: str, *by: str) -> None:
    """CSV files below path/<column>=<value>/..., blank text for null numbers."""
    df.write.partitionBy(*by).option("header", True).option("emptyValue", "").csv(path)


def read_predictions(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """All prediction files below path with their folder; read in parallel, only the asked columns parsed."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").schema(PREDICTIONS).csv(path)
    where = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "")
    return df.select(*(columns or df.columns), where.alias("folder"))


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """JSON manifests below path, one row each, with their folder."""
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path, wholetext=True)
    return df.select("value", F.regexp_replace(F.col("_metadata.file_path"), "/[^/]+$", "").alias("folder"))


def with_manifest(predictions: DataFrame, manifests: DataFrame, fields: str) -> DataFrame:
    """predictions with the scalar fields of the manifest beside them."""
    parsed = manifests.select("folder", F.from_json("value", fields).alias("m")).select("folder", "m.*")
    return predictions.join(parsed, "folder", "left")


def read_positions(spark: SparkSession, path: str) -> DataFrame:
    """Headerless position table: barcode, in_tissue, array_row, array_col, pixel_row, pixel_col."""
    return spark.read.schema("barcode string, in_tissue int, array_row int, array_col int, pixel_row double, pixel_col double").csv(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def samples_to_rows(wide: DataFrame, gene: str, samples: list[str]) -> DataFrame:
    """A genes x samples table in long form: sample, gene, value."""
    return wide.unpivot(gene, samples, "sample", "value").select("sample", F.col(gene).alias("gene"), F.col("value").cast("double").alias("value"))


def image_key(c):
    """File name of an image without its suffix .svs."""
    return F.regexp_replace(c, r"(?i)\.svs$", "")


def mean_coordinates(samples: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """samples with the mean x and y of their patches, 0 without any."""
    mean = patches.groupBy(key).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    return samples.join(mean, key, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("x", "y")})


def crop(image: np.ndarray, row: int, col: int, radius: int) -> np.ndarray:
    """Square patch of side 2 radius + 1 around a pixel, zeros outside the image."""
    side = 2 * radius + 1
    out = np.zeros((side, side, *image.shape[2:]), dtype=image.dtype)
    top, left = row - radius, col - radius
    r0, r1, c0, c1 = max(0, top), min(image.shape[0], top + side), max(0, left), min(image.shape[1], left + side)
    if r0 < r1 and c0 < c1:
        out[r0 - top : r1 - top, c0 - left : c1 - left] = image[r0:r1, c0:c1]
    return out


def embed_patches(patches: DataFrame, model, dim: int, batch: int = 64) -> DataFrame:
    """(key, embedding): model maps an array (n, ...) of patches, given as flat arrays, to (n, dim); Arrow batches, the model loaded once a task.

    model: callable without arguments that gives that function.
    """
    import pyarrow as pa

    def run(batches):
        f = model()
        for b in batches:
            for k in range(0, b.num_rows, batch):
                part = b.slice(k, batch)
                out = np.asarray(f(np.stack(part.column(1).to_numpy(zero_copy_only=False))), dtype=np.float32)
                if out.shape != (part.num_rows, dim):
                    raise ValueError(f"the model gave {out.shape}, not {(part.num_rows, dim)}")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(out), pa.list_(pa.float32()))], ["key", "embedding"])

    kind = dict(patches.dtypes)["key"]
    return patches.select("key", "pixels").mapInArrow(run, f"key {kind}, embedding array<float>")


def unfinished(variants: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Variants that a rerun still has to do."""
    return variants.join(done.select(key).distinct(), key, "left_anti")
