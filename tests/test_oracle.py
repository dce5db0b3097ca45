"""Every registered query with SQL against DuckDB, over the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from lattica import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = plans.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    run = duck.execute(plans.oracle_sql()[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == cols
    want = Counter(repr(tuple(plain(r[names.index(c)]) for c in cols)) for r in run.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql()) - {"N15"}))
def test_other_queries_run(spark, name):
    assert plans.queries()[name](spark, SF).limit(5).collect()
