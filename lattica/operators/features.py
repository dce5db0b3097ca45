"""Projection, sample vectors, classifiers and clustering."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def moments(df: DataFrame, vector: str, weight: str | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """(total weight, weighted sum, weighted Gramian) of a vector column: a matrix of each partition, added up in a tree."""

    def run(batches):
        total, first, second = 0.0, None, None
        for batch in batches:
            x = np.stack(batch.column(0).to_numpy(zero_copy_only=False)) if batch.num_rows else None
            if x is None:
                continue
            w = batch.column(1).to_numpy(zero_copy_only=False)
            xw = x * w[:, None]
            total += float(w.sum())
            first = xw.sum(axis=0) if first is None else first + xw.sum(axis=0)
            second = xw.T @ x if second is None else second + xw.T @ x
        if first is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([first.tobytes()], pa.binary()), pa.array([second.tobytes()], pa.binary())], ["w", "s", "g"])

    rows = df.select(F.col(vector).cast("array<double>"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")).mapInArrow(run, "w double, s binary, g binary")
    add = lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2])
    parsed = rows.rdd.map(lambda r: (r[0], np.frombuffer(bytes(r[1])), np.frombuffer(bytes(r[2]))))
    total, first, second = parsed.treeReduce(add)
    return total, first, second.reshape(len(first), len(first))


class Projection:
    """Centred (or not) linear projection onto leading components, the sign of each such that its largest entry is positive."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, variance: np.ndarray):
        self.mean, self.components, self.variance = mean, components, variance

    def transform(self, df: DataFrame, vector: str, out: str = "features") -> DataFrame:
        mean, comp = self.mean, self.components

        @F.pandas_udf("array<double>")
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list((np.stack(v.to_numpy()) - mean) @ comp)) if len(v) else pd.Series([], dtype=object)

        return df.withColumn(out, project(F.col(vector).cast("array<double>")))


def pca(df: DataFrame, vector: str, k: int, weight: str | None = None, centred: bool = True) -> Projection:
    """Principal components by (weighted) covariance, at most rows - 1; uncentred ones are the right singular vectors."""
    total, first, second = moments(df, vector, weight)
    mean = first / total if centred else np.zeros_like(first)
    cov = second / total - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    k = choose_components(int(total) if weight is None else len(first), len(first), k)
    top = vectors[:, ::-1][:, :k]
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(k)])
    return Projection(mean, top, values[::-1][:k])


def choose_components(n_rows: int, n_features: int, wanted: int) -> int:
    return max(1, min(wanted, n_rows - 1, n_features))


def component_counts(df: DataFrame, by: list[str], vector: str, wanted: int) -> DataFrame:
    """(by, components): choose_components for each group."""
    return df.groupBy(*by).agg(F.greatest(F.lit(1), F.least(F.lit(wanted), F.count("*") - 1, F.max(F.size(vector)))).cast("int").alias("components"))


def sample_vector(df: DataFrame, by: list[str], vector: str, p: int, weight: Column, quantiles: tuple[float, ...] = (0.1, 0.5, 0.9), places: int = 6) -> DataFrame:
    """Per sample one vector: weighted mean and std of each component, its unweighted quantiles, mean, std and range of x and y.

    Length 2 p + q p + 6. One aggregation over exploded-free columns: no shuffle but the grouping.
    """
    c = lambda i: F.col(vector)[i]
    aggs = [F.sum(weight).alias("_w")]
    for i in range(p):
        aggs += [F.sum(weight * c(i)).alias(f"_s{i}"), F.sum(weight * c(i) * c(i)).alias(f"_q{i}"), F.percentile(c(i), F.array(*(F.lit(q) for q in quantiles))).alias(f"_p{i}")]
    for a in ("x", "y"):
        aggs += [F.avg(a).alias(f"_m{a}"), F.stddev_pop(a).alias(f"_d{a}"), (F.max(a) - F.min(a)).alias(f"_r{a}")]
    g = df.groupBy(*by).agg(*aggs)
    means = [F.col(f"_s{i}") / F.col("_w") for i in range(p)]
    stds = [F.sqrt(F.greatest(F.col(f"_q{i}") / F.col("_w") - means[i] * means[i], F.lit(0.0))) for i in range(p)]
    quants = [F.col(f"_p{i}")[j] for j in range(len(quantiles)) for i in range(p)]
    coords = [F.col(f"_{k}{a}") for k in "mdr" for a in ("x", "y")]
    return g.select(*by, F.transform(F.array(*means, *stds, *quants, *coords), lambda v: F.round(v, places)).alias("features"))


def scaled(train: DataFrame, test: DataFrame, vector: str, d: int) -> tuple[DataFrame, DataFrame]:
    """Both sides divided by train's population standard deviation (1 where it is 0), not centred."""
    row = train.agg(*(F.stddev_pop(F.col(vector)[i]) for i in range(d))).first()
    scale = F.array(*(F.lit(float(s) if s else 1.0) for s in row))
    f = lambda df: df.withColumn(vector, F.zip_with(vector, scale, lambda a, b: a / b))
    return f(train), f(test)


#: Cells of the training matrix in a task of a fit.
TASK_CELLS = 1_000_000

_FACTORIES = {
    "lr": lambda d, k, seed: LogisticRegression(maxIter=100, standardization=False, weightCol="_w"),
    "gbt": lambda d, k, seed: GBTClassifier(maxIter=20, seed=seed, weightCol="_w") if k == 2 else OneVsRest(classifier=GBTClassifier(maxIter=20, seed=seed), weightCol="_w", parallelism=8),
    "forest": lambda d, k, seed: RandomForestClassifier(numTrees=50, seed=seed, weightCol="_w"),
    "mlp": lambda d, k, seed: MultilayerPerceptronClassifier(layers=[d, 64, k], maxIter=100, seed=seed),
}


def positive_rows(train: DataFrame, weight: str | None = None) -> DataFrame:
    """The rows that enter a weighted fit, with _w: those of weight above 0; all, with weight 1, without a weight column."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return train.withColumn("_w", w).where("_w > 0")


def fit_tasks(n: int, d: int | None) -> int:
    """Tasks of a step of a fit over n rows of d components: one for each TASK_CELLS cells."""
    return max(1, -(-n * (d or 1) // TASK_CELLS))


def train_classifier(train: DataFrame, vector: str, label: str, name: str = "lr", weight: str | None = None, c: float = 1.0, seed: int = 0) -> tuple[Model, Model]:
    """(indexer, model). Rows of weight 0 are left out and weights scaled to a mean of 1; the regularisation of lr is 1 / (c * sum of weights)."""
    rows = positive_rows(train, weight)
    mean, n, d = rows.agg(F.avg("_w"), F.count("*"), F.max(F.size(vector))).first()
    indexer = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc", handleInvalid="keep").fit(rows)
    k = len(indexer.labels)
    estimator = _FACTORIES[name](d, k, seed)
    if name == "lr":
        estimator = estimator.setRegParam(1.0 / (c * n))
    ready = indexer.transform(rows.withColumn("_w", F.col("_w") / mean)).withColumn("_f", array_to_vector(vector))
    if isinstance(estimator, OneVsRest):
        # the indexer's metadata count a class for unseen labels, of which no row is
        ready = ready.withColumn("_y", F.col("_y").alias("_y", metadata={}))
    # a fit runs hundreds of short jobs over the rows, whose time is that of their tasks' starts where tasks hold few rows
    ready = ready.select("_f", "_y", "_w").repartition(fit_tasks(n, d)).persist()
    try:
        return indexer, estimator.setFeaturesCol("_f").setLabelCol("_y").fit(ready)
    finally:
        ready.unpersist()


def predict(models: tuple[Model, Model], test: DataFrame, vector: str, positive: int | None = None) -> DataFrame:
    """test with y_pred, and with score, the probability of class number `positive`, if one is given.

    The probabilities of boosted trees for one class against the rest are divided by their sum.
    """
    indexer, model = models
    out = model.transform(test.withColumn("_f", array_to_vector(vector)))
    labels = F.array(*(F.lit(x) for x in indexer.labels))
    out = out.withColumn("y_pred", labels[F.col("prediction").cast("int")])
    if positive is not None and "probability" not in out.columns:
        each = F.transform(vector_to_array("rawPrediction"), lambda m: 1 / (1 + F.exp(-2 * m)))
        total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
        out = out.withColumn("score", F.get(each, F.lit(positive)) / total)
    elif positive is not None:
        out = out.withColumn("score", vector_to_array("probability")[positive])
    return out.select(*test.columns, "y_pred", *(["score"] if positive is not None else []))


def spatial_regions(df: DataFrame, k: int, least: int, seed: int = 42) -> DataFrame:
    """region by KMeans on coordinates scaled to unit population deviation; regions of fewer than `least` rows join the nearest larger one."""
    s = df.agg(F.avg("x"), F.stddev_pop("x"), F.avg("y"), F.stddev_pop("y")).first()
    z = df.withColumn("_v", array_to_vector(F.array((F.col("x") - s[0]) / (s[1] or 1.0), (F.col("y") - s[2]) / (s[3] or 1.0))))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="_c").fit(z)
    rows = model.transform(z)
    centres = model.clusterCenters()
    sizes = {r[0]: r[1] for r in rows.groupBy("_c").count().collect()}
    large = [i for i in range(len(centres)) if sizes.get(i, 0) >= least] or [max(sizes, key=sizes.get)]
    to = [i if i in large else min(large, key=lambda j: float(((centres[i] - centres[j]) ** 2).sum())) for i in range(len(centres))]
    return rows.withColumn("region", F.concat(F.lit("region_"), F.array(*(F.lit(t) for t in to))[F.col("_c")].cast("string"))).drop("_v", "_c")


def mixture(df: DataFrame, k: int, seed: int = 42) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(weight, mean, covariance) of the components of a Gaussian mixture on the coordinates."""
    model = GaussianMixture(k=k, seed=seed, featuresCol="_v").fit(df.withColumn("_v", array_to_vector(F.array("x", "y"))))
    rows = model.gaussiansDF.collect()
    return [(w, r["mean"].toArray(), r["cov"].toArray()) for w, r in zip(model.weights, rows)]


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Least-cost assignment of rows to columns of a rectangular matrix, by shortest augmenting paths."""
    flip = cost.shape[0] > cost.shape[1]
    a = cost.T if flip else cost
    n, m = a.shape
    u, v, way, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        low, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0, free = match[j0], ~used
            free[0] = False
            cur = a[i0 - 1] - u[i0] - v[1:]
            better = free[1:] & (cur < low[1:])
            low[1:][better], way[1:][better] = cur[better], j0
            j1 = int(np.where(free, low, np.inf).argmin())
            delta = low[j1]
            u[match[used]] += delta
            v[used] -= delta
            low[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((c, r) if flip else (r, c) for r, c in pairs)


def mapped_metrics(df: DataFrame, by: list[str], truth: str, cluster: str) -> DataFrame:
    """Macro precision, recall, f1 and false discovery rate after the best one-to-one mapping of clusters to labels; from contingency counts."""
    counts = df.groupBy(*by, truth, cluster).agg(F.count("*").alias("n"))
    kinds = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index=truth, columns=cluster, values="n", aggfunc="sum", fill_value=0).sort_index().sort_index(axis=1)
        m = table.to_numpy(dtype=float)
        p, r, f = [], [], []
        for i, j in hungarian(-m):
            precision, recall = m[i, j] / m[:, j].sum(), m[i, j] / m[i].sum()
            p.append(precision), r.append(recall), f.append(2 * precision * recall / (precision + recall) if m[i, j] else 0.0)
        keys = [pdf[c].iloc[0] for c in by]
        return pd.DataFrame([[*keys, *(round(float(np.mean(x)), 6) for x in (p, r, f)), round(1 - float(np.mean(p)), 6)]], columns=[*by, "precision", "recall", "f1", "fdr"])

    fields = ", ".join(f"{c} {kinds[c]}" for c in by)
    return counts.groupBy(*by).applyInPandas(run, f"{fields}, precision double, recall double, f1 double, fdr double")


def standardised(df: DataFrame, by: list[str], *cols: str) -> DataFrame:
    w = W.partitionBy(*by)
    return df.withColumns({c: (F.col(c) - F.avg(c).over(w)) / F.coalesce(F.nullif(F.stddev_pop(c).over(w), F.lit(0.0)), F.lit(1.0)) for c in cols})
