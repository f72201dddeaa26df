"""Plan guards: no Cartesian product, no nested-loop join, no row-at-a-time Python UDF, and
per-row Python (Arrow) only where it is documented (the p-value helpers of R02 and R06)."""

import pytest

from labeltab.plans.catalog import QUERIES
from tests.conftest import SF_SMALL
from tests.plan_review import SIDE_EFFECTS, plan_text, summary

NAMES = sorted(n for n in QUERIES if n not in SIDE_EFFECTS)
ARROW_OK = {"r02_anova_pvalue", "r06_chi2_pvalue"}


@pytest.mark.parametrize("name", NAMES)
def test_plan_guard(spark, name):
    s = summary(plan_text(QUERIES[name](spark, SF_SMALL)))
    assert not s["forbidden"], s
    if name not in ARROW_OK:
        assert s["python"] == 0, s


def test_categorical_relevance_needs_no_window(spark):
    assert summary(plan_text(QUERIES["r06_categorical_relevance"](spark, SF_SMALL)))["windows"] == 0
