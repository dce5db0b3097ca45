"""How well synthetic rows resemble real ones: one row of distribution, moment and spatial measures, from one long table of both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.bundle import stored
from . import metrics, spatial

#: Genes of largest variance whose Moran's I is averaged.
TOP_GENES = 100


def _divergence(shares: DataFrame, by: list[str]) -> DataFrame:
    """(by, jsd): Jensen-Shannon divergence in bits of the two sides' shares (side, by, bin, p)."""
    both = shares.groupBy(*by, "bin").agg(F.max(F.when(F.col("side") == "real", F.col("p"))).alias("a"), F.max(F.when(F.col("side") != "real", F.col("p"))).alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    return both.groupBy(*by).agg(F.greatest(F.sum((F.col("a") * F.log2(F.col("a") / m) + F.col("b") * F.log2(F.col("b") / m)) / 2), F.lit(0.0)).alias("jsd"))


def _mean_moran(long: DataFrame, genes: DataFrame, rows: DataFrame, by: str, key: str, k: int) -> DataFrame:
    """(side, moran): mean over each side's genes of largest variance; neighbours are the k nearest rows of the same side and group."""
    keyed = rows.select(F.concat_ws("|", "side", by).alias("_group"), key, F.array("x", "y").alias("_xy"), "side")
    near = spatial.knn_join(keyed, keyed, "_group", key, "_xy", k, "euclidean", exclude_self=True)
    edges = near.select(F.split_part("_group", F.lit("|"), F.lit(1)).alias("side"), F.col(key).alias("src"), F.col("neighbour").alias("dst"), F.lit(1.0).alias("w"))
    top = genes.where("variance > 0").withColumn("_r", F.row_number().over(W.partitionBy("side").orderBy(F.desc("variance"), "gene"))).where(F.col("_r") <= TOP_GENES).select("side", "gene")
    per = spatial.morans_i(long.join(top, ["side", "gene"]), edges, ["side", "gene"], key, "v", places=12)
    return per.groupBy("side").agg(F.avg("moran").alias("moran"))


def fidelity(real: DataFrame, synthetic: DataFrame, by: str = "slice_id", key: str = "obs_name", vector: str = "vec", k: int = 6, places: int = 6) -> DataFrame:
    """One row: n_real, n_synthetic, n_genes; global_jsd (50 bins), mean_gene_jsd and median_gene_jsd (30 bins, all of 0 to the largest value or 1);
    log ratio and Wasserstein distance of library sizes; difference of the shares of zeros; mean absolute differences of the genes' means and
    variances and the correlations of both; correlation of the sorted library sizes; mean Moran's I of each side and their difference.

    real and synthetic (by, key, x, y, vector): values below 0 count as 0. Sorted library sizes are paired rank by rank, as far as the shorter side goes.
    """
    cols = [by, key, "x", "y", vector]
    rows = real.select(F.lit("real").alias("side"), *cols).unionByName(synthetic.select(F.lit("synthetic").alias("side"), *cols))
    rows = stored(rows, "both-sides")
    long = rows.select("side", key, F.posexplode(vector).alias("gene", "v")).withColumn("v", F.greatest("v", F.lit(0.0)))
    top = long.agg(F.greatest(F.max("v"), F.lit(1.0)).alias("_top"))
    placed = long.crossJoin(F.broadcast(top))
    whole = _divergence(metrics.histogram(placed, ["side"], F.col("v"), F.col("_top"), 50), []).select(F.col("jsd").alias("global_jsd"))
    each = _divergence(metrics.histogram(placed, ["side", "gene"], F.col("v"), F.col("_top"), 30), ["gene"]).agg(F.avg("jsd").alias("mean_gene_jsd"), F.percentile("jsd", F.lit(0.5)).alias("median_gene_jsd"))
    genes = stored(long.groupBy("side", "gene").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("variance"), F.avg((F.col("v") == 0).cast("double")).alias("zero"), F.count("*").alias("n")), "genes")
    side = lambda df, name, *c: df.where(F.col("side") == name).select("gene", *(F.col(x).alias(f"{x}_{name}") for x in c))
    both = side(genes, "real", "mean", "variance", "zero", "n").join(side(genes, "synthetic", "mean", "variance", "zero", "n"), "gene")
    moments = both.agg(
        F.count("*").alias("n_genes"),
        F.max("n_real").alias("n_real"),
        F.max("n_synthetic").alias("n_synthetic"),
        (F.avg("zero_synthetic") - F.avg("zero_real")).alias("fraction_zero_delta"),
        F.avg(F.abs(F.col("mean_synthetic") - F.col("mean_real"))).alias("mean_gene_mean_abs_diff"),
        F.avg(F.abs(F.col("variance_synthetic") - F.col("variance_real"))).alias("mean_gene_var_abs_diff"),
    )
    corr = lambda df, a, b, name: metrics.safe_corr(df, [], a, b, 12).select(F.col("corr").alias(name))
    library = stored(long.groupBy("side", key).agg(F.sum("v").alias("library")), "libraries")
    sizes = library.groupBy().agg(*(F.avg(F.when(F.col("side") == s, F.col("library"))).alias(s) for s in ("real", "synthetic"))).select((F.log1p("synthetic") - F.log1p("real")).alias("library_size_log_ratio"))
    one = lambda s: library.where(F.col("side") == s).select(F.lit(1).alias("g"), F.round("library", 9).alias("library"))
    apart = metrics.wasserstein(one("real"), one("synthetic"), ["g"], "library", 12).select(F.col("w1").alias("library_size_wasserstein"))
    # ranks from counts of distinct sizes: each run of equal sizes spans a range of ranks, and ranges of both sides are joined where they meet
    runs = library.groupBy("side", "library").agg(F.count("*").alias("n")).withColumn("end", F.sum("n").over(W.partitionBy("side").orderBy("library")))
    run = lambda s: runs.where(F.col("side") == s).select(F.col("library").alias(s), (F.col("end") - F.col("n")).alias(f"s_{s}"), F.col("end").alias(f"e_{s}"))
    ranked = lambda s: run(s).select(s, F.explode(F.sequence(F.col(f"s_{s}"), F.col(f"e_{s}") - 1)).alias("rank"))
    totals = corr(ranked("real").join(ranked("synthetic"), "rank"), "real", "synthetic", "spot_total_correlation")
    morans = _mean_moran(long, genes, rows, by, key, k).groupBy().agg(*(F.max(F.when(F.col("side") == s, F.col("moran"))).alias(f"mean_morans_i_{s}") for s in ("real", "synthetic")))
    out = moments
    for part in (whole, each, sizes, apart, corr(both, "mean_real", "mean_synthetic", "gene_mean_correlation"), corr(both, "variance_real", "variance_synthetic", "gene_variance_correlation"), totals, morans):
        out = out.crossJoin(F.broadcast(part))  # one row each
    out = out.withColumn("morans_i_abs_diff", F.abs(F.col("mean_morans_i_synthetic") - F.col("mean_morans_i_real")))
    return out.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))
