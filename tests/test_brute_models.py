"""Queries without SQL against plain numpy over the whole smallest table."""

import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import features
from lattica.plans import queries
from lattica.plans.registry import real, spots

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_uncentred_components(spark):
    """N2: right singular vectors of the real rows, each with its largest entry positive, applied to all rows."""
    x = np.array([r.vec for r in real(spark, SF).select("vec").collect()])
    top = np.linalg.svd(x, full_matrices=False)[2][:10].T
    top = top * np.sign(top[np.abs(top).argmax(axis=0), np.arange(10)])
    rows = {r.obs_name: np.array(r.vec) @ top for r in spots(spark, SF).select("obs_name", "vec").collect()}
    got = queries()["N2"](spark, SF).collect()
    assert len(got) == len(rows)
    assert all(np.allclose(r.features, rows[r.obs_name], atol=2e-5) for r in got)


def test_mapped_metrics(spark):
    """E12: the best of all one-to-one mappings; ties between mappings are checked by what they map, the mean recall only where one is best."""
    rows = spots(spark, SF).select("slice_id", "label", (F.col("pos") % 5).alias("cluster"), (F.col("pos") % 3).alias("truth")).collect()
    df = spark.createDataFrame([(r.slice_id, f"t{r.truth if i % 4 else r.cluster % 3}", f"c{r.cluster}") for i, r in enumerate(rows)], "slice_id string, truth string, cluster string")
    got = {r.slice_id: r for r in features.mapped_metrics(df, ["slice_id"], "truth", "cluster").collect()}
    data = df.collect()
    for s in {r.slice_id for r in data}:
        t = sorted({r.truth for r in data if r.slice_id == s})
        c = sorted({r.cluster for r in data if r.slice_id == s})
        m = np.array([[sum(r.slice_id == s and r.truth == a and r.cluster == b for r in data) for b in c] for a in t], dtype=float)
        best = max(sum(m[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(len(c)), len(t)))
        options = []
        for p in itertools.permutations(range(len(c)), len(t)):
            if sum(m[i, j] for i, j in enumerate(p)) == best:
                pr = [m[i, j] / m[:, j].sum() for i, j in enumerate(p)]
                re = [m[i, j] / m[i].sum() for i, j in enumerate(p)]
                f1 = [2 * a * b / (a + b) if a + b else 0.0 for a, b in zip(pr, re)]
                options.append([np.mean(pr), np.mean(re), np.mean(f1), 1 - np.mean(pr)])
        one = [got[s].precision, got[s].recall, got[s].f1, got[s].fdr]
        assert any(np.allclose(one, o, atol=2e-6) for o in options)


def test_regions(spark):
    """N12: regions are no smaller than asked, and every row that kept its own region is nearest to that region's mean start."""
    got = queries()["N12"](spark, SF).join(real(spark, SF).select("obs_name", "x", "y"), "obs_name").collect()
    xy = np.array([[r.x, r.y] for r in got])
    z = (xy - xy.mean(axis=0)) / xy.std(axis=0)
    names = np.array([r.region for r in got])
    sizes = {n: int((names == n).sum()) for n in set(names.tolist())}
    assert len(got) == real(spark, SF).count() and min(sizes.values()) >= 5 and len(sizes) <= 6
    # no row is nearer to another region's mean than to its own by more than rounding, but for those that joined from small regions
    means = {n: z[names == n].mean(axis=0) for n in sizes}
    wrong = sum(min(means, key=lambda n: ((z[i] - means[n]) ** 2).sum()) != names[i] for i in range(len(z)))
    assert wrong <= 0.1 * len(z)
