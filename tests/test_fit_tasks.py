"""Fits of classifiers run in tasks of enough rows, however many partitions the session deals rows over."""

from pyspark.sql import functions as F

from lattica.operators import features as X


class Seen:
    def setFeaturesCol(self, _):
        return self

    setLabelCol = setFeaturesCol

    def fit(self, df):
        return df.rdd.getNumPartitions(), df.count(), sorted(df.columns)


def test_few_rows_are_fitted_in_one_task(spark, monkeypatch):
    monkeypatch.setitem(X._FACTORIES, "gbt", lambda d, k, seed: Seen())
    df = spark.range(90).repartition(40).select(F.array(F.rand(1), F.rand(2)).alias("vec"), F.concat(F.lit("L"), F.col("id") % 3).alias("label"))
    assert X.train_classifier(df, "vec", "label", "gbt")[1] == (1, 90, ["_f", "_w", "_y"])
    monkeypatch.setattr(X, "TASK_CELLS", 60)
    assert X.train_classifier(df, "vec", "label", "gbt")[1][:2] == (3, 90)
