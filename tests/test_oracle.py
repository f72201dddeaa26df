"""Every SQL-expressible query agrees with its independent DuckDB oracle (exact after the
6-decimal rounding both sides apply), on the sf0.001 tables."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tests.oracle_harness import compare

NAMES = sorted(E.oracle_sql())


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_oracle(spark, duck_small, name):
    r = compare(spark, duck_small, name, E.queries()[name], E.oracle_sql()[name], SF_SMALL)
    assert r["columns_match"], r.get("detail")
    assert r["spark_rows"] == r["oracle_rows"]
    assert r["exact"], r.get("detail")


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 4
    assert [f.name for f in df.schema.fields] == ["feature", "k", "n", "f_stat", "eta_squared", "mean_range",
                                                  "normalized_mean_range"]
