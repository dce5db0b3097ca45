"""Readers with rules, and what they refuse."""

import pytest
from pyspark.sql import functions as F

from lattica.operators import fidelity as Q
from lattica.sources import loaders as L


def test_label_files(spark, tmp_path):
    for k, (text, want) in enumerate((("obs_name,label,x\na,L,1\n", [("a", "L")]), ("id,label,x\n007,L,1\n", [("007", "L")]), ("id,x,layer\nb,1,M\n", [("b", "M")]))):
        (tmp_path / f"{k}.csv").write_text(text)
        assert [tuple(r) for r in L.evaluation_labels(spark, str(tmp_path / f"{k}.csv")).collect()] == want
    (tmp_path / "s.csv").write_text("sample_id,split\n007,1\n")
    assert [tuple(r) for r in L.split_table(spark, str(tmp_path / "s.csv")).collect()] == [("007", "1")]
    (tmp_path / "a.csv").write_text("region,alpha\nr,0.5\n")
    with pytest.raises(ValueError, match="region_id"):
        L.regional_alphas(spark, str(tmp_path / "a.csv"))
    assert L.regional_alphas(spark, None).count() == 0


def test_scan_of_common_columns(spark, tmp_path):
    spark.range(3).selectExpr("id", "1 as a", "2 as b").write.parquet(str(tmp_path / "x"))
    spark.range(2).selectExpr("3 as b", "id", "4 as c").write.parquet(str(tmp_path / "y"))
    df = L.common_columns(spark, {"x": str(tmp_path / "x"), "y": str(tmp_path / "y")}, ["id"])
    assert df.columns == ["sample", "id", "b"] and df.count() == 5
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,b:int>" in plan and "a:int" not in plan
    with pytest.raises(ValueError, match="a"):
        L.common_columns(spark, {"x": str(tmp_path / "x"), "y": str(tmp_path / "y")}, ["a"])


def test_labels_are_kept_apart(spark, tmp_path):
    df = spark.createDataFrame([("o", "L", 1.0)], "obs_name string, Label string, x double")
    clean = L.without_labels(df, str(tmp_path / "e"))
    assert clean.columns == ["obs_name", "x"] and L.without_labels(clean, str(tmp_path / "none")).columns == ["obs_name", "x"]
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError, match="label"):
        L.unsupervised_slices(df.withColumns({"slice_id": F.lit("s"), "split": F.lit("all"), "y": F.lit(0.0)}))
    with pytest.raises(ValueError, match="slice_id"):
        L.unsupervised_slices(clean)
    rows = spark.createDataFrame([("a", "s0", "all", 0.0, 0.0), ("b", "s1", "test", 0.0, 0.0)], "obs_name string, slice_id string, split string, x double, y double")
    assert [r[0] for r in L.unsupervised_slices(rows).collect()] == ["s0"]


def test_one_modality(spark):
    rna = spark.createDataFrame([("b", [1.0])], "barcode string, vector array<double>")
    notes = spark.createDataFrame([("b", "x"), ("c", "y")], "barcode string, note string")
    assert [tuple(r) for r in L.two_modalities(rna, notes).collect()] == [("b", "x", [1.0], None, False)]


def test_a_copy_is_faithful(spark):
    rows = spark.createDataFrame([(f"o{i}", "s", float(i % 5), float(i // 5), [float(i * k % 7) for k in range(1, 5)]) for i in range(30)], "obs_name string, slice_id string, x double, y double, vec array<double>")
    r = Q.fidelity(rows, rows.withColumn("obs_name", F.concat(F.lit("c"), "obs_name"))).first()
    assert r.n_real == r.n_synthetic == 30 and r.n_genes == 4
    assert r.global_jsd == r.mean_gene_jsd == r.library_size_wasserstein == r.fraction_zero_delta == r.mean_gene_mean_abs_diff == r.morans_i_abs_diff == 0
    assert r.gene_mean_correlation == r.gene_variance_correlation == r.spot_total_correlation == 1
