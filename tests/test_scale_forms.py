"""Steps that must not grow with the rows: shared binning, cells in place of rows, plans without row shuffles or second scans."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import Row
from pyspark.sql import functions as F

from labeltab.functions import sha256
from labeltab.operators import ensembles as E
from labeltab.operators import explain as EX
from labeltab.operators import models as ML
from labeltab.operators import split as S
from labeltab.operators import trees as T
from labeltab.plans import catalog as C
from labeltab.plans import fixtures as X
from labeltab.sources import io as IO
from tests.conftest import SF_SMALL


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def small_rows(spark, times=1):
    """Rows of two features whose classes overlap a little."""
    base = [(f"r{i}", float(i % 23), float(i % 7), (i % 23) // 5 if i % 11 else 0) for i in range(700)]
    df = spark.createDataFrame(base, "rid string, a double, b double, cls int")
    return df.crossJoin(spark.range(times).toDF("copy")).withColumn("rid", F.concat_ws("-", "rid", "copy")).drop("copy")


SPEC = X.D2_SPEC.with_(features=("a", "b"))


def test_results_by_cell_are_worked_out_once(spark):
    m = E.fit(small_rows(spark), ["a", "b"], "cls", 5, E.Boosting(5, "level"))
    seen = []

    def work(x):
        seen.append(len(x))
        return m.trees.scores(x)

    rng = np.random.default_rng(1)
    by_cell = T.ByCell(m.trees, 2, work)
    batches = [rng.uniform(-3, 30, (400, 2)) for _ in range(3)] + [np.array([[4.0, 3.0], [np.nextafter(4.0, 5), 3.0]]), np.zeros((0, 2))]
    for x in batches:
        assert np.array_equal(by_cell(x), m.trees.scores(x))
    assert sum(seen) <= np.prod([len(e) + 1 for e in by_cell.edges]) < 1200
    by_cell.coded = False
    assert np.array_equal(by_cell(batches[0]), m.trees.scores(batches[0]))


def test_presets_and_subsets_share_one_binning(spark, monkeypatch):
    calls, edges = [], E.bin_edges
    monkeypatch.setattr(E, "bin_edges", lambda *a: calls.append(1) or edges(*a))
    rows, p = small_rows(spark), E.Boosting(3, "symmetric", depth=3)
    presets = {"x": ML.Preset("x", "boosting", p), "y": ML.Preset("y", "boosting", E.Boosting(3, "level", depth=3))}
    fitted = ML.fit_all(rows, SPEC, presets)
    assert len(calls) == 1
    alone = ML.fit(rows, SPEC, presets["x"])
    assert np.array_equal(fitted["x"].trees.value, alone.trees.value) and fitted["x"].losses == alone.losses
    calls.clear()
    got = ML.ablation(rows, rows, SPEC, presets["x"], [("all", ["a", "b"]), ("b", ["b"])]).where("config = 'b'")
    assert len(calls) == 1
    want = ML.predict(ML.fit(rows, SPEC, presets["x"], ["b"]), rows, SPEC, "x")
    cols = ["rid", "prediction", F.round(F.col("probability")[0], 12).alias("p")]
    assert {tuple(r) for r in got.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}


RF = ML.Preset("rf", "rf", {"numTrees": 5, "maxDepth": 6, "maxBins": 16})
BACKGROUND = [[1.0, 2.0], [9.0, 0.0], [22.0, 6.0]]


def test_interventional_values_of_a_forest_do_not_expand_rows(spark, monkeypatch):
    m = ML.fit(small_rows(spark), SPEC, RF)
    odd = [("twice", 3.0, 1.0), ("twice", 3.0, 1.0), ("twice", 21.0, 1.0), (None, 8.5, 4.25), (None, 12.0, 3.0), ("low", float("-inf"), 2.0), ("high", 5.0, float("inf"))]
    rows = small_rows(spark).select("rid", "a", "b").unionByName(spark.createDataFrame(odd, "rid string, a double, b double"))
    for sampled in ({}, {"exact_max": 0, "permutations": 5}):
        by_cell = EX.shapley(m, rows, ["a", "b"], "rid", BACKGROUND, **sampled)
        with monkeypatch.context() as p:
            p.setattr(T, "CELLS", 1)
            expanded = EX.shapley(m, rows, ["a", "b"], "rid", BACKGROUND, **sampled)
        assert "Generate" in plan(expanded) and "Generate" not in plan(by_cell)
        got, want = ({(r.rid, r.predicted): [r.score, r.base, *r.contributions] for r in df.collect()} for df in (by_cell, expanded))
        assert got.keys() == want.keys() and len(got) == 700 + 6
        assert all(np.allclose(got[k], want[k], rtol=0, atol=1e-12) for k in got)
        assert all(got[k] == want[k] for k in got if k[0] and k[0].startswith("r"))  # bit by bit
    bad = spark.createDataFrame([("x", None, 1.0)], "rid string, a double, b double")
    with pytest.raises(Exception, match="null"):
        EX.shapley(m, bad, ["a", "b"], "rid", BACKGROUND).collect()


def test_other_models_are_not_taken_for_a_plain_forest(spark):
    m = ML.fit(small_rows(spark), SPEC, RF)
    assert EX._forest(m, spark, ["a", "b"]) is not None and EX._forest(m, spark, ["b", "a"]) is None
    ovr = ML.Preset("ovr", "ovr_gbt", {"maxIter": 2, "maxDepth": 2, "maxBins": 16})
    assert EX._forest(ML.fit(small_rows(spark), SPEC, ovr), spark, ["a", "b"]) is None
    index = StringIndexer(inputCol="colour", outputCol="b")
    rows = small_rows(spark).drop("b").withColumn("colour", F.concat(F.lit("c"), F.col("cls") % 3))
    coloured = index.fit(rows).transform(rows).withColumn("label", F.col("cls").cast("double"))
    assert EX._forest(ML.make_pipeline(RF, ["a", "b"]).fit(coloured), spark, ["a", "b"]) is None  # splits by sets of colours


def test_coalitions_are_worked_out_once_a_cell(monkeypatch):
    scores, seen = T.Trees.scores, []
    # feature 0 at 0.5, then feature 1 at 0.25 and feature 2 at 0.75
    t = T.Trees(np.array([0, 1, 2, -1, -1, -1, -1]), np.array([0.5, 0.25, 0.75, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]),
                np.array([2, 4, 6, -1, -1, -1, -1]), np.ones(7), np.array([[0, 0], [0, 0], [0, 0], [1, 0], [0.5, 0.5], [0.25, 0.75], [0, 1]]),
                np.array([0]), np.zeros(2), False)
    monkeypatch.setattr(T.Trees, "scores", lambda t, x: seen.append(len(x)) or scores(t, x))
    rng = np.random.default_rng(0)
    background, coef = rng.random((4, 3)), EX.coalition_coefficients(3)
    by_cell = T.Coalitions(t, 3, background, coef)
    assert T.n_cells(t, 3) == 8
    batches = [rng.random((1000, 3)) for _ in range(3)]
    got = [by_cell.sums(x) for x in batches]
    assert sum(seen) <= 8 + 4 * 3 ** 3  # cells, and the cells of each coalition with each background row
    for x, sums in zip(batches, got):
        for r in range(0, 1000, 50):
            cls = scores(t, x[r: r + 1])[0].argmax()
            want = np.zeros(3)
            for s, w in coef.items():
                mixed = np.where([s >> i & 1 for i in range(3)], x[r], background)
                want += np.array(w) * scores(t, mixed)[:, cls].sum()
            assert sums[r, 0] == cls and np.allclose(sums[r, 3:], want, atol=1e-12)


def test_one_vs_rest_takes_cells_and_predicts_without_python(spark, monkeypatch):
    sizes, make = [], ML.make_pipeline

    class Seen:
        def __init__(self, p):
            self.p = p

        def fit(self, cells):
            sizes.append((cells.count(), cells.agg(F.sum("weight")).first()[0]))
            return self.p.fit(cells)

    monkeypatch.setattr(ML, "make_pipeline", lambda *a, **k: Seen(make(*a, **k)))
    preset = ML.Preset("o", "ovr_gbt", {"maxIter": 3, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 0.9, "maxBins": 64})
    rows, many = small_rows(spark), small_rows(spark, 100)
    one, big = ML.fit(rows, SPEC, preset), ML.fit(many, SPEC, preset)
    cells = rows.select("a", "b", "cls").distinct().count()
    assert sizes[0] == (700, 700.0) and sizes[1][1] == 70000.0 and sizes[1][0] <= cells * ML.PARTS
    for m in (one, big):
        p = ML.predict(m, rows, SPEC, "o")
        assert "EvalPython" not in plan(p)
        own = m.transform(rows).select("rid", F.col("prediction").cast("int").alias("own"))
        got = p.join(own, "rid").agg(F.avg((F.col("prediction") == F.col("own")).cast("int")), F.avg((F.col("prediction") == F.col("label")).cast("int")),
                                     F.max(F.abs(F.aggregate("probability", F.lit(0.0), lambda a, x: a + x) - 1))).first()
        assert got[0] == 1 and got[1] > 0.85 and got[2] < 1e-9


def test_spark_forest_rows_are_spread(spark, monkeypatch):
    parts, make = [], ML.make_pipeline

    class Seen:
        def __init__(self, p):
            self.p = p

        def fit(self, data):
            parts.append(data.rdd.getNumPartitions())
            return self.p.fit(data)

    monkeypatch.setattr(ML, "make_pipeline", lambda *a, **k: Seen(make(*a, **k)))
    monkeypatch.setattr(ML, "ROWS_PER_PARTITION", 50, raising=False)
    ML.fit(small_rows(spark).coalesce(2), SPEC, ML.Preset("f", "rf", {"numTrees": 2, "maxDepth": 3}))
    assert parts == [14]


def test_stream_files_follow_the_rows(spark, monkeypatch):
    given, run = [], C.ST.run_stream
    monkeypatch.setattr(C.ST, "ROWS_PER_FILE", 40, raising=False)
    monkeypatch.setattr(C.ST, "run_stream", lambda *a: given.append((a[8:], spark.read.parquet(a[1]).inputFiles())) or run(*a))
    n = C.d2_test(spark, SF_SMALL).count()
    got = C.m30(spark, SF_SMALL)
    assert got.count() == n and len(given[0][1]) == -(-n // 40)
    assert given[0][0] == (min(-(-n // 40) // 4, 2 * spark.sparkContext.defaultParallelism),)


def test_json_leaves_reads_its_rows_once(spark, tmp_path):
    rows = [(1, '{"a":{"b":[1,{"c":null}]},"e":{}}'), (2, "{oops"), (3, None), (4, "[]"), (5, '"x"')]
    spark.createDataFrame(rows, "k int, doc string").write.parquet(str(tmp_path / "docs"))
    out = IO.json_leaves(spark.read.parquet(str(tmp_path / "docs")), "k", "doc")
    assert plan(out).count("FileScan parquet") == 1
    assert {tuple(r) for r in out.collect()} == {(1, "$.a.b[0]", "number", "1"), (1, "$.a.b[1].c", "null", None), (1, "$.e", "object", "{}"),
                                                 (2, "$", "malformed", "{oops"), (4, "$", "array", "[]"), (5, "$", "string", "x")}


def test_split_is_written_without_a_sort(spark, tmp_path):
    calls, df = [], S.stratified_split(small_rows(spark), SPEC)
    write = df.write.__class__.partitionBy
    try:
        df.write.__class__.partitionBy = lambda self, *a: calls.append(a) or write(self, *a)
        IO.write_split_table(df, spark.createDataFrame([("0", 0)], "label string, code int"), str(tmp_path))
    finally:
        df.write.__class__.partitionBy = write
    back = spark.read.parquet(str(tmp_path / "rows"))
    assert not calls and {tuple(r) for r in back.select(*df.columns).collect()} == {tuple(r) for r in df.collect()}
    assert back.schema["split"].dataType.simpleString() == "string"


def test_class_codes_come_by_broadcast(spark):
    dim = spark.createDataFrame([(str(i), i) for i in range(5)], "label string, code int")
    for df in (S.encode(small_rows(spark), SPEC, dim), S.decode(small_rows(spark), dim, "cls")):
        assert "BroadcastHashJoin" in plan(df) and "SortMergeJoin" not in plan(df)


def test_split_moves_no_rows_and_verdict_ranks_once(spark):
    text = plan(S.stratified_split(small_rows(spark), SPEC))
    assert "SortMergeJoin" not in text
    ranked = C.stability_inputs(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert ranked.count("row_number()") == 1


def test_sha256_goes_on_from_a_state():
    data = bytes(range(256)) * 3 + b"tail"
    for cut in (0, 1, 55, 64, 100, len(data)):
        held = sha256.update(sha256.begin(), data[:cut])
        assert sha256.hexdigest(sha256.update(held, data[cut:])) == hashlib.sha256(data).hexdigest()
        assert sha256.hexdigest(held) == hashlib.sha256(data[:cut]).hexdigest()


@pytest.fixture
def odd_files(tmp_path):
    rng = np.random.default_rng(5)
    noise = rng.integers(0, 256, 5500, np.uint8).tobytes()
    files = {"noise.bin": noise, "noise_nl.bin": noise + b"\n", "marked.bin": IO.BOM + noise, "marked_nl.bin": IO.BOM + noise + b"\n\n",
             "one_line.bin": noise.replace(b"\n", b"x"), "long line.bin": b"a\n" + b"\r\0" * 1700 + b"\n" + noise[:900], "nl.bin": b"\n" * 3000,
             "crlf[1]{a}.bin": b"\r\n" * 1000 + b"\r", "packed.gz": noise, "full.bin": noise[:999] + b"\n" + noise[:999] + b"\n",
             "at_most.bin": noise[:1000], "above.bin": noise[:1001]}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    return tmp_path, files


def test_digests_by_ranges_are_those_of_the_whole_file(spark, odd_files, monkeypatch):
    folder, files = odd_files
    seen, step = set(), IO._digest_range
    monkeypatch.setattr(IO, "_digest_range", lambda state, n, start, length: seen.add((start, length)) or step(state, n, start, length))
    got = {r.file_name: (r.length, r.sha256) for r in IO.file_digests(spark, str(folder), range_bytes=1000).collect()}
    assert got == {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in files.items()}
    assert seen == {(s, len(v)) for k, v in files.items() if len(v) > 1000 and not k.endswith(".gz") for s in range(0, len(v), 1000)}
    assert sorted(map(tuple, IO.file_digests(spark, str(folder)).collect())) == sorted((k, *v) for k, v in got.items())


def test_no_value_holds_a_large_file(spark, odd_files):
    """The source raises above its length limit (2 GB; here 1,000 bytes), as one value cannot hold more."""
    folder, files = odd_files
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, 1000)
    try:
        got = IO.file_digests(spark, str(folder), "*.bin", range_bytes=1000).collect()
    finally:
        spark.conf.unset(limit)
    assert {r.file_name: r.sha256 for r in got} == {k: hashlib.sha256(v).hexdigest() for k, v in files.items() if k.endswith(".bin")}


@pytest.mark.parametrize("length, says", [(5900, "5501 bytes read of 5900"), (9000, "cut into .2. ranges"), (5300, "5501 bytes read of 5300")])
def test_a_file_that_changes_while_it_is_read_raises(spark, odd_files, length, says):
    folder, _ = odd_files
    f = IO.list_files(spark, str(folder), "noise.bin").first()
    with pytest.raises(ValueError, match=says):
        IO._digests_by_range(spark, [Row(**f.asDict() | {"length": length})], 3000)
