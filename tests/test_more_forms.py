"""Wide correlation, positions in files, JSON leaves, file audit, name clashes."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltab.operators import contract as Q
from labeltab.operators import gram, profile, split
from labeltab.session import scratch_path
from labeltab.sources import io as IO
from labeltab.spec import TableSpec


def test_wide_correlation_of_many_features(spark):
    rng = np.random.default_rng(0)
    n, f = 400, 300
    x = rng.normal(1e6, 1, (n, f))
    x[:, 1] = x[:, 0] * 2 + 5
    x[:, 2] = 7.0
    x[rng.random((n, f)) < 0.2] = np.nan
    cols = [f"c{i}" for i in range(f)]
    df = spark.createDataFrame([tuple(None if math.isnan(v) and i % 2 else v for i, v in enumerate(r)) for r in x.tolist()],
                               ", ".join(f"{c} double" for c in cols)).repartition(7)
    got = {(r.i, r.j): r.correlation for r in gram.wide_correlation(df, cols).collect()}
    assert len(got) == f * f
    for i, j in [(0, 1), (0, 0), (3, 4), (4, 3), (299, 17), (2, 5)]:
        ok = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
        if 2 in (i, j):
            assert got[i, j] is None
        else:
            assert abs(got[i, j] - np.corrcoef(x[ok, i], x[ok, j])[0, 1]) < 1e-9
    strong = gram.strong_pairs(gram.wide_correlation(df.select(cols[:6]), cols[:6])).collect()
    assert [(r.feature_a, r.feature_b) for r in strong] == [("c0", "c1")]


def test_wide_correlation_edges(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert {(r.feature_a, r.feature_b): r.correlation for r in gram.wide_correlation(df, ["a", "b"]).collect()} == {
        ("a", "a"): None, ("a", "b"): None, ("b", "a"): None, ("b", "b"): None}
    assert gram.wide_correlation(df.where("a = 9"), ["a", "b"]).where("correlation IS NOT NULL").count() == 0


def test_duplicate_positions_over_files(spark):
    path = scratch_path(spark, "positions")
    rows = [(i, f"v{i % 5 if i in (3, 8, 13) else i}", None if i in (1, 18) else 1.0) for i in range(20)]
    rows[18] = (18, "v1", None)
    for part in range(4):
        spark.createDataFrame(rows[part * 5: part * 5 + 5], "id int, a string, b double").coalesce(1).write.mode("append").parquet(f"{path}/p={part}")
    got = Q.duplicate_positions(spark, path, ["a", "b"]).orderBy("position").collect()
    assert [(r.position, r.line_number, r.a, r.group_size) for r in got] == [
        (1, 3, "v1", 2), (3, 5, "v3", 3), (8, 10, "v3", 3), (13, 15, "v3", 3), (18, 20, "v1", 2)]


def test_json_leaves(spark):
    doc = {"a": {"b": [1, "x", {"c": None, "d": True}], "e": {}}, "f": [], "g": 2.5}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{oops"), (3, None), (4, "7"), (5, "[[1],[2,3]]")], "k int, doc string")
    got = {}
    for r in IO.json_leaves(df, "k", "doc").collect():
        got.setdefault(r.k, {})[r.path] = (r.kind, r.value)
    assert got[1] == {"$.a.b[0]": ("number", "1"), "$.a.b[1]": ("string", "x"), "$.a.b[2].c": ("null", None), "$.a.b[2].d": ("boolean", "true"),
                      "$.a.e": ("object", "{}"), "$.f": ("array", "[]"), "$.g": ("number", "2.5")}
    assert got[2] == {"$": ("malformed", "{oops")} and 3 not in got and got[4] == {"$": ("number", "7")}
    assert got[5] == {"$[0][0]": ("number", "1"), "$[1][0]": ("number", "2"), "$[1][1]": ("number", "3")}
    with pytest.raises(ValueError, match="deeper"):
        IO.json_leaves(df.where("k = 1"), "k", "doc", max_depth=2)


def test_audit_of_files(spark):
    cols = "file_name string, length long, sha256 string"
    before = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("c", 1, "z")], cols)
    after = spark.createDataFrame([("a", 1, "x"), ("b", 2, "w"), ("d", 1, "z")], cols)
    assert {r.file_name: r.status for r in IO.audit_files(before, after).collect()} == {"a": "same", "b": "changed", "c": "removed", "d": "added"}


def test_crosstab_with_a_class_named_other(spark):
    df = spark.createDataFrame([("x", "other"), ("x", "a"), ("x", "zzz"), ("y", "a")], "cat string, label string")
    got = profile.crosstab(df, "cat", TableSpec(features=(), target="label", expected_classes=("a", "other"))).orderBy("category").collect()
    assert (got[0].n_a, got[0].n_other, got[0].n_other_labels, got[1].n_a, got[1].n_other) == (1, 1, 1, 1, 0)


@pytest.mark.parametrize("rows_per_bucket", [3, 1000])
def test_class_rank_does_not_depend_on_buckets(spark, rows_per_bucket):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).cast("string").alias("label"))
    spec = TableSpec(features=(), target="label", key="k")
    got = {r.k: r.rank_in_class for r in split.class_rank(df, spec, rows_per_bucket=rows_per_bucket).collect()}
    rows = sorted((r.label, r["__h"], r.k) for r in split.class_rank(df, spec).collect())
    for lab in "012":
        assert [got[k] for x, _, k in rows if x == lab] == list(range(1, 1 + sum(x == lab for x, _, _ in rows)))
