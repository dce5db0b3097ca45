"""Meta genes: sums and differences of genes that single out a domain, found by repeated contrasts.

Each round compares the domain's spots with the other spots whose meta value is as high as the domain's mean, adds the gene that tells
the domain best and takes away the one that tells the others best. Only a row of each round reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.bundle import stored

#: Fewer spots than this on one side end the search.
LEAST = 5


@dataclass
class MetaGene:
    """name, the steps that were taken (plus, minus, mean difference, non-target spots) and (spot, meta)."""

    name: str
    steps: list[dict] = field(default_factory=list)
    values: DataFrame | None = None


def contrast(expr: DataFrame, groups: DataFrame, gene: str = "gene_idx", spot: str = "spot", value: str = "value") -> DataFrame:
    """(gene, z): rank sum score of each gene between the spots with inside and the other spots of groups (spot, inside).

    Spots without a row for a gene have 0 there; ties share their mean rank, the variance is that without ties. The window runs over the distinct
    values of a gene, not over its rows.
    """
    sides = groups.agg(F.count_if("inside").alias("na"), F.count_if(~F.col("inside")).alias("nb"))
    met = expr.where(F.col(value) != 0).join(groups, spot)
    counts = met.groupBy(gene, F.col(value).alias("v")).agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b"))
    genes = expr.select(gene).distinct().join(met.groupBy(gene).agg(F.count_if("inside").alias("sa"), F.count_if(~F.col("inside")).alias("sb")), gene, "left")
    zero = genes.crossJoin(F.broadcast(sides)).select(gene, F.lit(0.0).alias("v"), (F.col("na") - F.coalesce("sa", F.lit(0))).alias("a"), (F.col("nb") - F.coalesce("sb", F.lit(0))).alias("b"))
    every = counts.withColumn("v", F.col("v").cast("double")).unionByName(zero)
    both = F.col("a") + F.col("b")
    before = F.coalesce(F.sum(both).over(W.partitionBy(gene).orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = every.withColumn("rank", before + (both + 1) / 2).groupBy(gene).agg(F.sum("a").cast("double").alias("na"), F.sum("b").cast("double").alias("nb"), F.sum(F.col("a") * F.col("rank")).alias("w"))
    n = F.col("na") + F.col("nb") + 1
    return sums.select(gene, ((F.col("w") - F.col("na") * n / 2) / F.sqrt(F.col("na") * F.col("nb") * n / 12)).alias("z"))


def _means(rows: DataFrame, value: str):
    return rows.agg(F.avg(F.when(F.col("target"), F.col(value))).alias("inside"), F.avg(F.when(~F.col("target"), F.col(value))).alias("outside")).first()


def find_meta_gene(expr: DataFrame, domains: DataFrame, target: str, start, rounds: int = 5, early_stop: bool = True, gene: str = "gene_idx", spot: str = "spot", value: str = "value") -> MetaGene:
    """The meta gene of a domain, from one gene on.

    expr (spot, gene, value), domains (spot, domain): each spot once. The search ends after `rounds`, when either side of a contrast has fewer
    than 5 spots, or (early_stop) when a round would leave more non-target spots or a smaller difference of means than the one before;
    that round's genes are not taken. Genes of one score go by their order.
    """

    def of(g, name):
        return expr.where(F.col(gene) == g).groupBy(spot).agg(F.sum(value).cast("double").alias(name))

    now = domains.select(spot, F.coalesce(F.col("domain") == target, F.lit(False)).alias("target")).join(of(start, "meta"), spot, "left")
    now = stored(now.select(spot, "target", F.coalesce("meta", F.lit(0.0)).alias("meta")), "meta")
    out, others, difference = MetaGene(str(start)), now.count(), 0.0
    for _ in range(rounds):
        level = _means(now, "meta")["inside"]
        if level is None:
            break
        groups = now.where((F.col("meta") > level) | F.col("target")).select(spot, F.col("target").alias("inside"))
        inside, outside = groups.agg(F.count_if("inside"), F.count_if(~F.col("inside"))).first()
        if min(inside, outside) < LEAST:
            break
        scores = stored(contrast(expr, groups, gene, spot, value), "contrast")
        plus, minus = scores.orderBy(F.desc("z"), gene).first()[0], scores.orderBy("z", gene).first()[0]
        moved = now.join(of(plus, "plus"), spot, "left").join(of(minus, "minus"), spot, "left").select(spot, "target", (F.col("meta") + F.coalesce("plus", F.lit(0.0)) - F.coalesce("minus", F.lit(0.0))).alias("raw"))
        least = moved.agg(F.min("raw").alias("least"))
        new = stored(moved.crossJoin(F.broadcast(least)).select(spot, "target", (F.col("raw") - F.col("least")).alias("meta")), "meta")
        means = _means(new, "meta")
        gained = means["inside"] - (means["outside"] or 0.0)
        if early_stop and (outside > others or gained < difference):
            break
        others, difference, now = outside, gained, new
        out.name += f"+{plus}-{minus}"
        out.steps.append({"plus": plus, "minus": minus, "difference": gained, "others": outside})
    out.values = now.select(spot, "meta")
    return out


def meta_values(expr: DataFrame, domains: DataFrame, target: str, start, **columns: str) -> DataFrame:
    """(spot, meta) of the search with its usual settings: at most three rounds, stopped early."""
    return find_meta_gene(expr, domains, target, start, rounds=3, **columns).values
