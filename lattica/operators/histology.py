"""Histology axis: mean colours of image patches by summed-area tables, so a patch of any size is four look-ups.

Prefix sums are made within tiles of an image, whose windows hold a tile's rows or columns; the sums that stand left of and above a tile are carried
by the tiles' edges alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.bundle import stored

TILE = 256


def summed_area(pixels: DataFrame, channels: list[str], by: str = "image", tile: int = TILE) -> DataFrame:
    """(by, row, col, channels): of each pixel the sums over all pixels up to its row and its column.

    pixels (by, row, col, channels): every pixel of an image once, from (0, 0) on.
    """
    placed = pixels.select(by, "row", "col", F.floor(F.col("row") / tile).alias("_i"), F.floor(F.col("col") / tile).alias("_j"), *channels)
    along = W.partitionBy(by, "_i", "_j", "row").orderBy("col").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(by, "_i", "_j", "col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    inner = placed.withColumns({c: F.sum(c).over(along) for c in channels}).withColumns({c: F.sum(c).over(down) for c in channels})
    inner = stored(inner, "tiles")

    def before(rows: DataFrame, keys: list[str], order: str, mark: str) -> DataFrame:
        w = W.partitionBy(by, *keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return rows.select(by, *keys, order, *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{mark}{c}") for c in channels))

    last = lambda order: [F.max_by(c, order).alias(c) for c in channels]
    left = before(inner.groupBy(by, "_j", "row").agg(*last(F.col("col"))), ["row"], "_j", "_l")
    top = before(inner.groupBy(by, "_i", "col").agg(*last(F.col("row"))), ["col"], "_i", "_t")
    whole = inner.groupBy(by, "_i", "_j").agg(*last(F.struct("row", "col")))
    rows_of_tiles = before(whole, ["_i"], "_j", "")
    corner = before(rows_of_tiles, ["_j"], "_i", "_c")
    joined = inner.join(left, [by, "row", "_j"]).join(top, [by, "col", "_i"]).join(corner, [by, "_i", "_j"])
    return joined.select(by, "row", "col", *((F.col(c) + F.col(f"_l{c}") + F.col(f"_t{c}") + F.col(f"_c{c}")).alias(c) for c in channels))


def patch_means(spots: DataFrame, pixels: DataFrame, channels: list[str], key: str, beta: int = 49, by: str = "image", tile: int = TILE) -> DataFrame:
    """(by, key, channels): mean colours of the square of round(beta / 2) pixels on each side of a spot (by, key, row, col), cut at the image's
    border; null for a spot of whose square nothing lies in the image."""
    half = round(beta / 2)
    sums = stored(summed_area(pixels, channels, by, tile), "sums")
    size = pixels.groupBy(by).agg(F.max("row").alias("_h"), F.max("col").alias("_w"))
    low = lambda c: F.greatest(F.col(c) - half, F.lit(0))
    ends = spots.join(size, by).select(by, key, low("row").alias("r0"), F.least(F.col("row") + half, F.col("_h")).alias("r1"), low("col").alias("c0"), F.least(F.col("col") + half, F.col("_w")).alias("c1"))
    ends = stored(ends, "patches")
    corner = lambda r, c, sign: F.struct(r.cast("long").alias("row"), c.cast("long").alias("col"), F.lit(sign).alias("sign"))
    r0, r1, c0, c1 = (F.col(c) for c in ("r0", "r1", "c0", "c1"))
    corners = F.array(corner(r1, c1, 1), corner(r0 - 1, c1, -1), corner(r1, c0 - 1, -1), corner(r0 - 1, c0 - 1, 1))
    inside = ends.where("r0 <= r1 and c0 <= c1").withColumn("area", (r1 - r0 + 1) * (c1 - c0 + 1))
    asked = inside.select(by, key, "area", F.inline(F.filter(corners, lambda p: (p["row"] >= 0) & (p["col"] >= 0))))
    met = asked.join(sums.withColumns({c: F.col(c).cast("long") for c in ("row", "col")}), [by, "row", "col"])
    means = met.groupBy(by, key).agg(*((F.sum(F.col("sign") * F.col(c)) / F.max("area")).alias(c) for c in channels))
    return spots.select(by, key).join(means, [by, key], "left")


def histology_axis(means: DataFrame, channels: list[str], key: str, by: str = "image") -> DataFrame:
    """(by, key, grey): the channels' mean weighted by their variance over the spots of the image; null where no channel varies."""
    spread = means.groupBy(by).agg(*(F.var_pop(c).alias(f"_v{c}") for c in channels))
    top = sum((F.col(c) * F.col(f"_v{c}") for c in channels[1:]), F.col(channels[0]) * F.col(f"_v{channels[0]}"))
    total = sum((F.col(f"_v{c}") for c in channels[1:]), F.col(f"_v{channels[0]}"))
    return means.join(spread, by).select(by, key, F.try_divide(top, total).alias("grey"))
