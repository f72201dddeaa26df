"""R05 with the nearest-neighbour estimator: mutual information between a continuous feature and the class.

For each row, r is the distance to its k-th nearest other row of the same class (k = 3, or one less than the
class has rows), and m the number of rows of any class nearer than r, itself included (rows of equal value where r
is 0; a distance within 1e-9 of r counts as r, so that rounding breaks no ties). With n_c rows in class c of N,

    MI = psi(N) + mean psi(k) - mean psi(n_c) - mean psi(m),    not below 0.

Classes of one row take no part. Distinct values are sorted once into range partitions
(``labeltab.functions.ranked``). A partition gets, for each of its classes, the k class values before and after it from a
summary of all partitions' ends, so distances are found in place. Both ends of a radius are then ranked in the
partition they fall into. Only distinct (feature, value, class) rows are moved, so a value held by a third of all rows is
one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltab.functions.ranked import ROWS_PER_PART, Ranked, ranked
from labeltab.operators.relevance import _long_values
from labeltab.spec import TableSpec

#: the least radius: only equal values are nearer
TINY = 5e-324
TIE = 1e-9
QUERIES = "feature string, pid int, value double, code int, n long, r double, high boolean"
RANKS = "feature string, value double, code int, n long, rows long"
HALO = "feature string, pid int, value double, code int, n long"


def digamma(x: np.ndarray) -> np.ndarray:
    """psi of positive numbers: recurrence up to 10, then the asymptotic series."""
    x = np.asarray(x, float).copy()
    out = np.zeros_like(x)
    while (x < 10).any():
        small = x < 10
        out[small] -= 1 / x[small]
        x[small] += 1
    i = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))


def kth_distance(v: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Distance from each distinct value (ascending, with its number of rows) to the k-th nearest other row."""
    far = np.full((len(v), 2 * k + 1), np.inf)
    times = np.zeros((len(v), 2 * k + 1))
    far[:, 0], times[:, 0] = 0.0, n - 1
    for j in range(1, min(k, len(v) - 1) + 1):
        gap = v[j:] - v[:-j]
        far[j:, 2 * j - 1], times[j:, 2 * j - 1] = gap, n[:-j]
        far[:-j, 2 * j], times[:-j, 2 * j] = gap, n[j:]
    order = np.argsort(far, 1, kind="stable")
    seen = np.cumsum(np.take_along_axis(times, order, 1), 1)
    at = (seen >= k).argmax(1)
    return np.take_along_axis(far, np.take_along_axis(order, at[:, None], 1), 1)[:, 0]


def _halo_group(k: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """For one (feature, class): the k rows before and after every partition that holds the class."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        pid, v, n = (t.column(c).to_numpy() for c in ("pid", "value", "n"))
        order = np.argsort(v, kind="stable")
        pid, v, n = pid[order], v[order], n[order]
        rows, to = [], []
        for p in np.unique(pid):
            s, e = np.searchsorted(pid, p, "left"), np.searchsorted(pid, p, "right")
            near = np.concatenate([np.arange(max(0, s - k), s), np.arange(e, min(len(v), e + k))])
            rows.append(near)
            to.append(np.full(len(near), p, np.int32))
        rows, to = np.concatenate(rows), np.concatenate(to)
        return pa.table({"feature": pa.array([key[0].as_py()] * len(rows), pa.string()), "pid": pa.array(to, pa.int32()),
                         "value": v[rows], "code": pa.array(np.full(len(rows), key[1].as_py(), np.int32)), "n": n[rows]})

    return run


def _radius_group(k: int, sizes: dict[tuple[str, int], int], first: dict[str, tuple[np.ndarray, np.ndarray]]
                  ) -> Callable[[tuple, pa.Table, pa.Table], pa.Table]:
    """For one (feature, partition): both ends of the radius of each row, sent to the partition they fall into."""

    def run(key: tuple, own: pa.Table, halo: pa.Table) -> pa.Table:
        feature = key[0].as_py()
        starts, pids = first[feature]
        out = []
        for code in np.unique(own.column("code").to_numpy()) if own.num_rows else []:
            parts = [[t.column(c).to_numpy()[t.column("code").to_numpy() == code] for c in ("value", "n")] for t in (own, halo)]
            v, n = (np.concatenate([a, b]) for a, b in zip(*parts))
            mine = np.arange(len(v)) < len(parts[0][0])
            order = np.argsort(v, kind="stable")
            v, n, mine = v[order], n[order], mine[order]
            r = np.maximum(kth_distance(v, n, min(k, sizes[feature, int(code)] - 1)) * (1 - TIE), TINY)[mine]
            v, n = v[mine], n[mine]
            for high in (True, False):
                at = np.maximum(_first_not(starts, v, r, high) - 1, 0)
                out.append(pa.table({"feature": pa.array([feature] * len(v), pa.string()), "pid": pa.array(pids[at], pa.int32()), "value": v,
                                     "code": pa.array(np.full(len(v), code, np.int32)), "n": n, "r": r, "high": np.full(len(v), high)}))
        return pa.concat_tables(out) if out else pa.schema(
            [("feature", pa.string()), ("pid", pa.int32()), ("value", pa.float64()), ("code", pa.int32()), ("n", pa.int64()),
             ("r", pa.float64()), ("high", pa.bool_())]).empty_table()

    return run


def _first_not(values: np.ndarray, x: np.ndarray, r: np.ndarray, high: bool) -> np.ndarray:
    """How many of the ascending values v satisfy v - x < r (``high``) or x - v >= r, for each x."""
    lo, hi = np.zeros(len(x), np.int64), np.full(len(x), len(values))
    while (lo < hi).any():
        mid = (lo + hi) // 2
        v = values[np.minimum(mid, len(values) - 1)]
        inside = (v - x < r) if high else (x - v >= r)
        inside &= lo < hi
        lo, hi = np.where(inside, mid + 1, lo), np.where(inside | (lo >= hi), hi, mid)
    return lo


def _rank_group(key: tuple, asked: pa.Table, rows: pa.Table) -> pa.Table:
    v, where = np.unique(rows.column("value").to_numpy(), return_inverse=True)
    total = np.concatenate([[0], np.cumsum(np.bincount(where, rows.column("n").to_numpy()))]).astype(np.int64)
    before = rows.column("before")[0].as_py() if rows.num_rows else 0
    x, r, high = (asked.column(c).to_numpy(zero_copy_only=False) for c in ("value", "r", "high"))
    got = np.zeros(len(x), np.int64)
    for side in (True, False):
        some = high == side
        got[some] = (before + total[_first_not(v, x[some], r[some], side)]) * (1 if side else -1)
    return pa.table({"feature": asked.column("feature"), "value": x, "code": asked.column("code").cast(pa.int32()), "n": asked.column("n"),
                     "rows": got})


def _psi_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum of n psi(m) of each feature in a task."""
    sums: dict[str, float] = {}
    for batch in batches:
        each = batch.column(1).to_numpy() * digamma(batch.column(2).to_numpy())
        names, where = np.unique(np.array(batch.column(0).to_pylist(), object), return_inverse=True)
        for name, s in zip(names, np.bincount(where, each)) if len(each) else []:
            sums[name] = sums.get(name, 0.0) + float(s)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.float64())], names=["feature", "s"])


def neighbour_information(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None, k: int = 3,
                          rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(feature, n, mi) in nats. Missing and infinite values and missing classes take no part; a feature whose
    classes have one row each has no row."""
    feats = list(features or spec.features)
    vals = _long_values(df, spec, feats).where(F.abs("value") < float("inf"))
    vals = vals.withColumn("value", F.col("value").cast("double") + 0.0)
    classes = [r.label for r in vals.select("label").distinct().orderBy("label").collect()]  # the class domain
    code = F.create_map(*[F.lit(x) for i, c in enumerate(classes) for x in (c, i)])[F.col("label")] if classes else F.lit(0)
    coded = vals.select("feature", "value", code.cast("int").alias("label"))
    count = {(r.feature, r.label): r.n for r in coded.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    alone = [f"{f}|{c}" for (f, c), n in count.items() if n < 2]
    if alone:
        coded = coded.where(~F.concat_ws("|", "feature", "label").isin(alone))
    sizes = {x: n for x, n in count.items() if n > 1}
    names = {f: sum(n for (g, _), n in sizes.items() if g == f) for f, _ in sizes}
    spark = df.sparkSession
    if not names:
        return spark.createDataFrame([], "feature string, n long, mi double")
    r = ranked(coded, rows_per_part)
    m = neighbours(r, k, sizes).groupBy("feature", "value", "code", "n").agg(F.sum("rows").alias("m"))
    psi = m.select("feature", "n", "m").mapInArrow(_psi_batches, "feature string, s double").groupBy("feature").agg(F.sum("s").alias("s"))
    fixed = []
    for f, total in names.items():
        n_c = np.array([n for (g, _), n in sizes.items() if g == f], float)
        fixed.append((f, int(total), float(digamma(np.array([total]))[0] + (n_c * (digamma(np.minimum(k, n_c - 1)) - digamma(n_c))).sum() / total)))
    terms = spark.createDataFrame(fixed, "feature string, n long, a double")  # one row a feature
    return terms.join(psi, "feature").select("feature", "n", F.greatest(F.lit(0.0), F.col("a") - F.col("s") / F.col("n")).alias("mi"))


def neighbours(r: Ranked, k: int, sizes: dict[tuple[str, int], int]) -> DataFrame:
    """(feature, value, code, n, rows): two signed ranks for each distinct row; their sum is m."""
    rows = r.rows.withColumnRenamed("label", "code")
    own = Window.partitionBy("feature", "pid", "code")
    ends = (rows.withColumn("a", F.row_number().over(own.orderBy("value"))).withColumn("b", F.row_number().over(own.orderBy(F.desc("value"))))
            .where(F.least("a", "b") <= k).select("feature", "code", "pid", "value", "n"))
    halo = ends.groupBy("feature", "code").applyInArrow(_halo_group(k), HALO)
    first: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    found: dict[str, list] = {}
    for p in r.parts.select("feature", "pid", "first").collect():  # one row a partition and feature
        found.setdefault(p.feature, []).append((p.first, p.pid))
    for f, x in found.items():
        x.sort()
        first[f] = (np.array([a for a, _ in x], float), np.array([b for _, b in x], np.int32))
    asked = (rows.groupBy("feature", "pid").cogroup(halo.groupBy("feature", "pid"))
             .applyInArrow(_radius_group(k, sizes, first), QUERIES))
    ranks = rows.join(r.parts.select("feature", "pid", "before"), ["feature", "pid"]).select("feature", "pid", "value", "n", "before")
    return asked.groupBy("feature", "pid").cogroup(ranks.groupBy("feature", "pid")).applyInArrow(_rank_group, RANKS)
