"""Correlation of wide tables (A09, A10) by masked Gram matrices.

A task turns its Arrow batches into numpy blocks and adds up, over the rows where both features of a pair are present,
their number, sums, squares and products; features are shifted by their means first, so large values cancel nothing.
Each task sends one row per feature (sums against all later features); rows of one feature are added in a tree of
``FAN`` tasks a node. The plan has no expression per pair, and a task holds six matrices of features x features.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltab.functions.exprs import clean_number

FAN = 64
SUMS = "i int, part int, sums array<double>"
KEYS = "count", "a", "b", "aa", "bb", "ab"


def _partial(names: Sequence[str], shift: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    f = len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, f, f))
        for batch in batches:
            x = np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns], 1) - shift
            here = ~np.isnan(x)
            x = np.where(here, x, 0.0)
            m = here.astype(float)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        n, a, aa, ab = total
        part = TaskContext.get().partitionId()
        for i in range(f):
            sums = np.stack([n[i], a[i], a[:, i], aa[i], aa[:, i], ab[i]])[:, i:].ravel()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([sums], pa.list_(pa.float64()))],
                                             names=["i", "part", "sums"])

    return run


def _add(key: tuple, t: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(x.values) for x in t.column("sums")], axis=0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()),
                     "sums": pa.array([total], pa.list_(pa.float64()))})


def _pairs(names: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sums in zip(batch.column(0).to_pylist(), batch.column(2)):
                n, a, b, aa, bb, ab = np.asarray(sums.values).reshape(len(KEYS), -1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    va, vb, cov = aa - a * a / n, bb - b * b / n, ab - a * b / n
                    r = np.where((va > 1e-12 * np.maximum(aa, 1e-300)) & (vb > 1e-12 * np.maximum(bb, 1e-300)) & (n > 0), cov / np.sqrt(va * vb), np.nan)
                r = np.clip(r, -1.0, 1.0)
                j = np.arange(i, len(names))
                both = [(i, j, r), (j[1:], np.full(len(j) - 1, i), r[1:])]
                for x, y, v in both:
                    x = np.broadcast_to(x, v.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[k] for k in x], pa.string()), pa.array([names[k] for k in y], pa.string()), pa.array(x.astype(np.int32)),
                         pa.array(np.asarray(y).astype(np.int32)), pa.array(v, from_pandas=True)],
                        names=["feature_a", "feature_b", "i", "j", "correlation"])

    return run


def wide_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, i, j, correlation): Pearson on pairwise complete rows, full square; null where a feature of the
    pair is constant on them or they are empty. Missing values (null, NaN) are left out pair by pair; infinite ones give null."""
    names = list(features)
    vals = [clean_number(f, df.schema[f].dataType).cast("double").alias(f"v{i}") for i, f in enumerate(names)]
    x = df.select(*vals)
    finite = [F.when(F.abs(F.col(f"v{i}")) < float("inf"), F.col(f"v{i}")) for i in range(len(names))]
    mean = x.agg(*[F.avg(c) for c in finite]).first()
    shift = np.array([m if m is not None else 0.0 for m in mean], float)
    sums, parts = x.mapInArrow(_partial(names, shift), SUMS), max(1, x.rdd.getNumPartitions())
    while parts > 1:
        sums, parts = sums.withColumn("part", F.expr(f"part DIV {FAN}").cast("int")).groupBy("i", "part").applyInArrow(_add, SUMS), -(-parts // FAN)
    return sums.mapInArrow(_pairs(names), "feature_a string, feature_b string, i int, j int, correlation double")


def strong_pairs(correlation: DataFrame, threshold: float = 0.7) -> DataFrame:
    """A10 on the long form: pairs i < j with |r| >= threshold, strongest first."""
    return (correlation.where((F.col("i") < F.col("j")) & (F.abs("correlation") >= threshold))
            .orderBy(F.desc(F.abs("correlation")), "i", "j").select("feature_a", "feature_b", "correlation"))
