"""Scoring-side operators on probability and contribution arrays.

All row-local: array functions (``array_max``, ``array_position``, ``posexplode``,
``sort_array``) inside one projection, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confidence(df: DataFrame, probs: str = "probability", key: str = "row_id",
               classes: Sequence | None = None) -> DataFrame:
    """Arg-max class (first maximum wins) and its probability."""
    idx = F.array_position(F.col(probs), F.array_max(probs)) - 1
    pred = idx.cast("int")
    if classes is not None:
        pred = F.array(*[F.lit(c) for c in classes])[idx]
    return df.select(key, pred.alias("predicted"), F.array_max(probs).alias("confidence"))


def probability_table(df: DataFrame, classes: Sequence, probs: str = "probability", key: str = "row_id") -> DataFrame:
    """One row per (row, class): probability, percent and rank (probability desc, ties by
    class). Raises in the plan when a vector's length differs from the class count."""
    k = len(classes)
    checked = F.when(F.size(probs) == k, F.col(probs)).otherwise(
        F.raise_error(F.format_string(f"Probability vector length mismatch. Expected {k}, found %d", F.size(probs))))
    t = df.select(key, checked.alias("__p"))
    p = [F.col("__p")[i] for i in range(k)]  # fixed k: plain indexing stays in codegen (no lambda)
    structs = F.array(*[F.struct((-p[i]).alias("neg"), F.lit(str(c)).alias("class"), p[i].alias("probability"))
                        for i, c in enumerate(classes)])
    ranked = F.posexplode(F.sort_array(structs))
    return t.select(key, ranked.alias("pos", "s")).select(
        key, F.col("s.class").alias("class"), F.col("s.probability").alias("probability"),
        (F.col("s.probability") * 100.0).alias("percent"), (F.col("pos") + 1).cast("int").alias("rank"))


def rank_contributions(df: DataFrame, features: Sequence[str], key: str = "row_id",
                       contrib: str = "contributions") -> DataFrame:
    """Per row, features ordered by |contribution| (desc, ties by name); bar length =
    |c| / max |c| of the row (0 when all are 0)."""
    c = [F.col(contrib)[i] for i in range(len(features))]  # fixed length: no lambda
    structs = F.array(*[F.struct((-F.abs(c[i])).alias("neg"), F.lit(f).alias("feature"), c[i].alias("contribution"))
                        for i, f in enumerate(features)])
    mx = F.greatest(*[F.abs(x) for x in c]) if len(c) > 1 else F.abs(c[0])
    t = df.select(key, mx.alias("mx"), F.posexplode(F.sort_array(structs)).alias("pos", "s"))
    return t.select(key, F.col("s.feature").alias("feature"), F.col("s.contribution").alias("contribution"),
                    F.abs("s.contribution").alias("abs_contribution"), (F.col("pos") + 1).cast("int").alias("rank"),
                    F.when(F.col("mx") > 0, F.abs("s.contribution") / F.col("mx")).otherwise(F.lit(0.0)).alias("bar"))


def golden_cases(pred: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Expected vs predicted per case with PASS/FAIL (``cases``) and the pass rate per
    expected class and overall (``summary``, a rollup — no window over all cases)."""
    j = expected.join(pred, key)
    status = F.when(F.col("expected") == F.col("predicted"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    return j.select(key, "expected", "predicted", status.alias("status"))


def golden_summary(cases: DataFrame) -> DataFrame:
    g = cases.withColumn("expected", F.col("expected").cast("string")).rollup("expected").agg(
        F.grouping("expected").alias("g"),
        F.count(F.lit(1)).alias("n_cases"), F.count_if(F.col("status") == "PASS").alias("n_pass"))
    return g.select(F.when(F.col("g") == 1, F.lit("*")).otherwise(F.col("expected")).alias("expected"),
                    F.col("n_cases").cast("bigint"), F.col("n_pass").cast("bigint"),
                    (F.col("n_pass") / F.col("n_cases")).alias("pass_rate"))
