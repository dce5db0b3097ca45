"""Scalar functions as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_token(c: Column) -> Column:
    """Runs of characters other than letters, digits, _ . - become one _; none at either end; 'value' if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), F.lit("_")), F.lit("")), F.lit("value"))


def general_format(c: Column) -> Column:
    """A number as short decimal text: no trailing zeros, no point for whole numbers (six places at most)."""
    fixed = F.format_string("%.6f", c.cast("double"))
    return F.when(c.isNotNull(), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", ""))


def variant_id(family: Column, ratio: Column, alpha: Column) -> Column:
    """family[_ratio<r>][_alpha<a>]"""
    return F.concat_ws("_", family, F.when(ratio.isNotNull(), F.concat(F.lit("ratio"), general_format(ratio))), F.when(alpha.isNotNull(), F.concat(F.lit("alpha"), general_format(alpha))))


def point_free(c: Column) -> Column:
    """A number for use in a path: its point as p."""
    return F.replace(general_format(c), F.lit("."), F.lit("p"))


def pool_tag(ratio: Column) -> Column:
    return F.concat(F.lit("pool_"), general_format(ratio), F.lit("x"))


def fraction_tag(fraction: Column) -> Column:
    return F.concat(F.lit("fraction"), F.bround(fraction * 100).cast("int").cast("string"))


def stable_seed(base: int | Column, *parts: Column) -> Column:
    """base + the first 32 bits of SHA-256 of the parts, joined by two bars, modulo 100000."""
    text = F.concat_ws("||", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))
    base = F.lit(base) if isinstance(base, int) else base
    return base + F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long") % 100000


def label_seed(label: Column) -> Column:
    return F.crc32(label.cast("binary"))


def hash_order(seed: int, *ids: Column) -> Column:
    """Sort key of a seeded pseudo-random order that does not depend on partitions or engine."""
    return F.md5(F.concat_ws("||", F.lit(str(seed)), *(i.cast("string") for i in ids)))


def disease_label(c: Column, cases: dict[str, str], default: str = "Other") -> Column:
    """The label whose key the trimmed upper-case text equals or contains, in the order given."""
    text, out = F.upper(F.trim(F.coalesce(c, F.lit("")))), None
    for key, label in cases.items():
        hit = text.contains(key.upper())
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def first_known(*candidates: Column, default: str) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in candidates), F.lit(default))


def task_name(given: Column, mode: Column, dataset: Column) -> Column:
    return F.coalesce(
        F.nullif(F.trim(given), F.lit("")),
        F.when(mode == "unsupervised", "spatial_cluster").when(dataset != "DLPFC", "sample_disease_prediction").when(mode == "low_label", "supervised_low_label").otherwise("cross_slice_generalization"),
    )


def quantile_bin(value: Column, edges: Column) -> Column:
    """Number of inner edges at or below the value (edges sorted, distinct); 0 if there are fewer than three."""
    inner = F.slice(edges, 2, F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(F.size(edges) < 3, 0).otherwise(F.size(F.filter(inner, lambda e: e <= value)))


def equal_width_bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    span = F.greatest(high - low, F.lit(1e-9))
    return F.least(F.greatest(F.floor((value - low) / span * bins), F.lit(0)), F.lit(bins - 1)).cast("int")


def log_normalised(value: Column, total: Column, target: float = 1e4) -> Column:
    """log1p of the value scaled to a total of target; 0 for a total of 0."""
    return F.log1p(F.coalesce(F.try_divide(value * target, total), F.lit(0.0)))


def logistic(x: Column, middle: Column | float, slope: Column | float) -> Column:
    z = F.greatest(F.least(-F.lit(slope) * (x - F.lit(middle)), F.lit(700.0)), F.lit(-700.0))
    return 1 / (1 + F.exp(z))


def scrubbed(x: Column, top: float = float("inf")) -> Column:
    """NaN, infinities and nulls as 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == top), 0.0).otherwise(x)


def counts_of(x: Column) -> Column:
    """Rounded half to even, not below 0."""
    return F.greatest(F.bround(scrubbed(x)), F.lit(0.0)).cast("long")


def number_list(c: Column, default: Column | None = None) -> Column:
    """'1, 2,x,3' as [1, 2, 3]; empty or null as the default."""
    out = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return out if default is None else F.when(F.size(out) > 0, out).otherwise(default)


def to_number(c: Column) -> Column:
    """Text to number; blank and malformed as null."""
    return F.trim(c).try_cast("double")


def variance_floor(c: Column, least: float = 1e-8) -> Column:
    return F.greatest(F.coalesce(F.var_samp(c), F.lit(0.0)), F.lit(least))


def linear_betas(steps: int) -> list[float]:
    """Variances of a linear noise schedule, for any number of steps like that of 1000."""
    low, high = 0.0001 * 1000 / steps, 0.02 * 1000 / steps
    return [low + (high - low) * k / max(1, steps - 1) for k in range(steps)]


def cosine_betas(steps: int, most: float = 0.999) -> list[float]:
    level = lambda t: math.cos((t + 0.008) / 1.008 * math.pi / 2) ** 2
    return [min(1 - level((k + 1) / steps) / level(k / steps), most) for k in range(steps)]
