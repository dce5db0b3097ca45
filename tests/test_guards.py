"""Guards that stop a run."""

import pytest

from lattica.operators import contracts as C


def test_guards(spark):
    df = spark.createDataFrame([("s0", 1), ("s0", 2), (None, 3)], "slice_id string, n int")
    assert C.some_rows(df, "local") is df
    for none in (None, df.where("n > 9")):
        with pytest.raises(ValueError, match="local"):
            C.some_rows(none, "local")
    fixed = {"backends": ["pca"], "seeds": [42]}
    given = {"backends": ["pca"], "seeds": ["42"], "slices": ["s0"]}
    assert C.fixed_run(given, fixed) is given
    for wrong in ({**given, "seeds": [42, 43]}, {"backends": ["pca"]}, {}):
        with pytest.raises(ValueError, match="seeds"):
            C.fixed_run(wrong, fixed)
    C.one_value(df.where("n < 3"), "slice_id")
    with pytest.raises(ValueError, match="'n'"):
        C.one_value(df, "n")
