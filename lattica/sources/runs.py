"""What a run reads and writes: checked inputs of paradigms and clusterings, views of generators, patches and their embeddings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import forbid_labels, require_columns, some_rows, spot_rules, training_rows, violations
from ..operators.tables import aligned_genes
from .bundle import embed_patches
from .package import committed, read_package, read_packages, write_package

#: Side of the tiles in which pixels meet patches.
TILE = 64


def task_of(dataset: str, mode: str) -> str:
    """Name of the task of a data set and mode, a part of output paths."""
    return {"supervised": "supervised_low_label", "unsupervised": "spatial_cluster"}.get(mode, f"{dataset}_{mode}")


def paradigm_inputs(spark: SparkSession, real_path: str, pool_path: str, output_root: str, dataset: str, mode: str, model: str | None = None, standard_layout: bool = True) -> tuple[dict[str, DataFrame], dict[str, DataFrame], str]:
    """(real, pool, output folder): the packages spots, genes and expr of both sides as a paradigm needs them.

    The pool must have rows; they must be synthetic, named, within a slice, and with finite coordinates that are not both 0, else a
    ValueError names what breaks how many of them. Of the real rows those of split train (or all, if none is) stay. Both sides have the genes that both know,
    in the order of the real side, numbered anew. model: the generator that the manifest of the pool names, unless given.
    """
    real, _ = read_package(spark, real_path)
    pool, info = read_package(spark, pool_path)
    spots = require_columns(some_rows(pool["spots"], "a paradigm"), "obs_name", "slice_id", "x", "y", "source")
    rules = spot_rules() | {"not_synthetic": ~F.col("source").eqNullSafe("synthetic")}
    if broken := {r["rule"]: r["n"] for r in violations(spots, rules).where("n > 0").collect()}:  # a row a rule
        raise ValueError(f"rows of the pool break rules: {broken}")
    kept = training_rows(real["spots"]) if "split" in real["spots"].columns else real["spots"]
    genes = aligned_genes(real["genes"], pool["genes"])
    side = lambda expr, old: expr.withColumnRenamed("gene_idx", old).join(genes.select(old, "gene_idx"), old).drop(old)
    of_kept = side(real["expr"], "old_a").join(kept.select("obs_name"), "obs_name", "left_semi")
    named = genes.select("gene", "gene_idx")
    model = model or info.get("generator") or "unknown"
    out = f"{output_root}/{task_of(dataset, mode)}/{dataset}/{model}/{mode}" if standard_layout else output_root
    return {"spots": kept, "genes": named, "expr": of_kept}, {"spots": spots, "genes": named, "expr": side(pool["expr"], "old_b")}, out


def clustering_input(rows: DataFrame, slice_id: str | None = None) -> DataFrame:
    """The rows of one slice (of all, without a name) as a clustering may see them: no columns that tell a label. No rows are an error."""
    some = rows if slice_id is None else rows.where(F.col("slice_id").cast("string") == slice_id)
    if forbid_labels(some, "unsupervised").isEmpty():
        raise ValueError(f"no rows of slice {slice_id}")
    return some


def write_model_views(spark: SparkSession, root: str, canonical: str, mode: str, views: dict[str, Callable[[DataFrame], DataFrame] | None], name: str = "data") -> None:
    """For each generator the input it reads, below root/<generator>/<mode>.

    A generator with a function gets a package of its own, made from the canonical one; one without gets a manifest that links to the canonical
    package, so nothing is copied. An unsupervised input must not tell labels.
    """
    data = read_package(spark, canonical)[0][name]
    for model, view in views.items():
        made = forbid_labels(view(data) if view else data, mode)
        write_package(spark, f"{root}/{model}/{mode}", {name: made} if view else {}, {"generator": model, "linked": None if view else canonical})


def read_model_view(spark: SparkSession, root: str, model: str, mode: str, name: str = "data") -> DataFrame:
    """The input of a generator, through its link if it has one."""
    tables, info = read_package(spark, f"{root}/{model}/{mode}")
    return (read_package(spark, info["linked"])[0] if info["linked"] else tables)[name]


def cropped(pixels: DataFrame, patches: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(key, pixels): for each patch (key, image, row, col) the values of the square of side 2 radius + 1 around its pixel, row by row, 0 where
    the image has no pixel.

    pixels: (image, row, col, value), one row a pixel. Pixels meet patches by tile, so a patch reads the few tiles it touches, and neither an
    image nor its list of patches is in one task. Patches of images without pixels, and those far outside, are all 0. Keys are unique.
    """
    side = 2 * radius + 1
    at = lambda c: F.floor(c / F.lit(tile)).cast("long")
    tiles = pixels.where("value is not null").groupBy("image", at(F.col("row")).alias("_r"), at(F.col("col")).alias("_c")).agg(F.collect_list(F.struct("row", "col", "value")).alias("_tile"))  # at most tile * tile
    span = lambda c: F.explode(F.sequence(at(F.col(c) - radius), at(F.col(c) + radius)))
    asked = patches.select("key", "image", "row", "col")
    touched = asked.withColumn("_r", span("row")).withColumn("_c", span("col")).join(tiles, ["image", "_r", "_c"])
    near = F.filter("_tile", lambda p: (F.abs(p["row"] - F.col("row")) <= radius) & (F.abs(p["col"] - F.col("col")) <= radius))
    place = lambda p: ((p["row"] - F.col("row") + radius) * side + p["col"] - F.col("col") + radius).cast("int")
    parts = touched.select("key", F.transform(near, lambda p: F.struct(place(p).alias("key"), p["value"].cast("double").alias("value"))).alias("_part"))
    filled = parts.groupBy("key").agg(F.map_from_entries(F.flatten(F.collect_list("_part"))).alias("_at"))
    value = F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: F.coalesce(F.try_element_at("_at", i), F.lit(0.0)))
    return asked.select("key").join(filled, "key", "left").select("key", value.alias("pixels"))


def embed_missing(spark: SparkSession, patches: DataFrame, root: str, model, dim: int, batch: int = 64) -> int:
    """Embeds the patches (key, pixels) whose key no committed run below root has, and commits them as a run; how many rows it added."""
    have = embeddings(spark, root)
    todo = patches if have is None else patches.join(have.select("key"), "key", "left_anti")
    if todo.isEmpty():
        return 0
    manifest = write_package(spark, f"{root}/run-{uuid.uuid4().hex}", {"embeddings": embed_patches(todo, model, dim, batch)}, {"dim": dim})
    return manifest["tables"]["embeddings"]["rows"]


def embeddings(spark: SparkSession, root: str) -> DataFrame | None:
    """(key, embedding) of all committed runs below root; None without any. Runs of other lengths are an error."""
    dims = {m["info"]["dim"] for m in committed(spark, f"{root}/run-*")}
    if len(dims) > 1:
        raise ValueError(f"embeddings of lengths {sorted(dims)} in one folder")
    return read_packages(spark, f"{root}/run-*", "embeddings")
