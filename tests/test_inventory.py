"""Column inventory and row digests against plain Python on awkward values."""

import math

import pytest
from pyspark.sql import functions as F

from labeltab.operators import contract, inventory

SCHEMA = "a double, b string, `c.d` decimal(38,2), e string, f array<string>, g date"
ROWS = [(0.0, "x", None, "1", ["1", None], None), (-0.0, "x", None, "1.0", [None, "1"], None), (float("nan"), "", None, " ", None, None),
        (None, None, None, None, None, None), (float("inf"), "y", None, "5d", [], None), (1e300, "xy", None, "inf", ["1", None], None),
        (0.0, "x", None, "NaN", ["1", None], None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumn("c.d", F.when(F.col("b") == "x", F.lit("12345678901234567890.25").cast("decimal(38,2)")))


def test_inventory_of_awkward_values(odd):
    got = {r.column_name: r for r in inventory.column_inventory(odd, parsed=["e"]).collect()}
    counts = {c: (r.missing_values, r.unique_values, r.infinite_values, r.invalid_numeric_values, r.constant_column) for c, r in got.items()}
    assert counts == {"a": (3, 3, 1, 0, False), "b": (2, 4, 0, 0, False), "c.d": (5, 1, 0, 0, True), "e": (4, 2, 1, 1, False),
                      "f": (3, 3, 0, 0, False), "g": (8, 0, 0, 0, True)}
    assert got["e"].feature_type == "numeric" and math.isclose(got["a"].missing_pct, 37.5)


@pytest.mark.parametrize("held", [0, 3, 1 << 20])
def test_inventory_does_not_depend_on_tasks_and_memory(spark, held):
    df = spark.range(3000, numPartitions=1).select((F.col("id") % 700).alias("a"), F.concat(F.lit("t"), F.col("id") % 1100).alias("b"),
                                                   F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("c"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        for n in (1, 7):
            assert [r.unique_values for r in inventory.column_inventory(df.repartition(n), held=held).collect()] == [700, 1100, 1001]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_inventory_of_an_empty_table(spark):
    rows = inventory.column_inventory(spark.createDataFrame([], "a int, b string")).collect()
    assert [(r.column_name, r.missing_values, r.missing_pct, r.unique_values, r.constant_column) for r in rows] == [
        ("a", 0, None, 0, True), ("b", 0, None, 0, True)]


def test_row_keys_keep_nulls_and_columns_apart(spark, odd):
    df = spark.createDataFrame([("a", None), (None, "a"), ("a", None), ("ab", "c"), ("a", "bc"), (None, None), (None, None)], "x string, y string")
    assert contract.duplicate_count(df).first().n_duplicates == 2
    assert contract.duplicate_count(odd).first().n_duplicates == 1
    assert contract.duplicate_count(odd, ["a", "b", "f"]).first().n_duplicates == 2  # 0.0 and -0.0 are equal, the arrays are not


def test_inventory_scans_once_and_duplicates_ship_digests(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    plan = inventory.column_inventory(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Expand" not in plan
    plan = contract.duplicate_count(df)._jdf.queryExecution().executedPlan().toString()
    shuffled = [x for x in plan.split("\n") if "Exchange hashpartitioning" in x]
    assert len(shuffled) == 1 and "l_extendedprice" not in shuffled[0]
