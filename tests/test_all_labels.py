import os

import pytest

from lattica import plans
from lattica.plans.registry import spots

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", ["N4", "N5", "N5_forest", "N6", "N7"])
def test_classifiers_learn_every_label(spark, name):
    every = {r.label for r in spots(spark, SF).where("label is not null").select("label").distinct().collect()}
    got = plans.queries()[name](spark, SF).collect()
    assert len(every) > 2 and {r.label for r in got} == every
    assert {r.y_pred for r in got} <= every and len({r.y_pred for r in got}) > 2
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_of_every_label(spark):
    n8, n7 = (plans.queries()[k](spark, SF) for k in ("N8", "N7"))
    assert n8.count() == n7.count()
