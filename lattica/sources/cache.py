"""Results that are kept by what they were made of: parameters and the rows of the inputs.

An entry is a package below root/<scope>/<name>-<key>. Its key is made of the parameters, and its manifest has a fingerprint of each input: the same
rows in any order and partitions give the same one. An entry whose inputs have changed is made anew and the old rows are dropped.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import features as X
from .package import committed, read_package, write_package


def fingerprint(df: DataFrame) -> str:
    """Schema, number of rows and two sums of row hashes, in one pass over the rows."""
    cols = [F.col(f"`{c}`") for c in df.columns]
    n, *sums = df.agg(F.count("*"), *(F.sum(F.xxhash64(F.lit(seed), *cols).cast("decimal(38,0)")) for seed in (1, 2))).first()
    return hashlib.sha256(json.dumps([df.schema.simpleString(), n, *(str(s or 0) for s in sums)]).encode()).hexdigest()[:32]


def key(parameters: dict) -> str:
    return hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:16]


def feature_key(model: Column, seed: Column, slice_: Column, family: Column, k: int) -> Column:
    """Key of a slice's projected features: projections of the synthetic pool alone are fitted on it, all others on the real training rows."""
    scope = F.when(family == "global_synthetic_only", "synthetic_pool").otherwise("real_train")
    return F.concat_ws("|", model, seed.cast("string"), slice_, family, scope, F.lit(str(k)))


class Cache:
    """Kept results below root, in the shared folder of the session; scopes (a data set, a fold) keep entries apart."""

    def __init__(self, spark: SparkSession, root: str, *scope: str):
        self.spark, self.root, self.scope = spark, root, scope
        self.hits, self.built = 0, 0

    def scoped(self, *scope: str) -> Cache:
        return Cache(self.spark, self.root, *self.scope, *scope)

    def table(self, name: str, parameters: dict, inputs: dict[str, DataFrame], build: Callable[[], DataFrame]) -> DataFrame:
        """What build() gives, read where it was made before with these parameters and these rows of the inputs."""
        path = "/".join([self.root, *self.scope, f"{name}-{key(parameters)}"])
        prints = {k: fingerprint(df) for k, df in sorted(inputs.items())}
        old = committed(self.spark, path)
        if old and old[-1]["info"]["inputs"] == prints:
            self.hits += 1
        else:
            write_package(self.spark, path, {"result": build()}, {"inputs": prints, "parameters": json.loads(json.dumps(parameters, default=str))})
            self.built += 1
            for m in old[-1:]:
                # overwritten by no rows: the files of what is out of date go
                self.spark.createDataFrame([], StructType.fromJson(m["tables"]["result"]["schema"])).write.mode("overwrite").parquet(f"{path}/data/{m['attempt']}/result")
        return read_package(self.spark, path)[0]["result"]

    def projection(self, rows: DataFrame, vector: str, k: int, **parameters) -> X.Projection:
        """Principal components of the rows, kept as a table of a row for each component (and the mean, number 0)."""

        def build():
            p = X.pca(rows, vector, k)
            kept = [(0, 0.0, p.mean.tolist())] + [(i + 1, float(v), c.tolist()) for i, (v, c) in enumerate(zip(p.variance, p.components.T))]
            return self.spark.createDataFrame(kept, "component int, variance double, vector array<double>")

        mean, *rest = self.table("projection", {"k": k, "vector": vector, **parameters}, {"rows": rows.select(vector)}, build).orderBy("component").collect()  # k + 1 rows
        return X.Projection(np.array(mean["vector"]), np.array([r["vector"] for r in rest]).T, np.array([r["variance"] for r in rest]))

    def fold_projection(self, real: DataFrame, fold: int, train: list[str], k: int, sample: str = "slice_id", vector: str = "vec") -> X.Projection:
        """Components fitted on the training samples of a fold; another fold, or other samples, is another entry."""
        return self.scoped(f"fold{fold}").projection(real.where(F.col(sample).isin(train)), vector, k, train=sorted(map(str, train)))

    def projected(self, rows: DataFrame, fit_on: DataFrame, vector: str, k: int, **parameters) -> DataFrame:
        """rows with `features`, their projection on the components of fit_on; fitted and projected once for all variants that use them."""
        return self.table("projected", {"k": k, "vector": vector, **parameters}, {"rows": rows, "fit": fit_on.select(vector)}, lambda: self.projection(fit_on, vector, k).transform(rows, vector))

    def weighted_package(self, builder: Callable, real: DataFrame, synthetic: DataFrame, ratio: float, alphas: list[float], seed: int, **parameters) -> dict[float, DataFrame]:
        """The package of each alpha. Its rows do not depend on alpha, so they are sampled once and only the weights differ."""
        from ..operators import paradigm

        rows = self.table("package", {"ratio": ratio, "seed": seed, **parameters}, {"real": real, "synthetic": synthetic}, lambda: builder(real, synthetic, ratio, 0.5, seed).drop("loss_weight"))
        none = rows.where("augmentation_source = 'real'")
        return {a: paradigm.weights(rows if a else none, [], a) for a in alphas}
