"""Projection, filter and cleaning operators.

Each cleaning step is a lazy filter/projection; the lineage report (C07) counts every stage
from **one** grouped pass instead of materialising each intermediate table.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.functions.exprs import BLANK_RE, is_missing
from labeltab.operators.contract import invalid_row_mask
from labeltab.spec import TableSpec


# Method tags of the missing-value step.
METHOD_DROPPED = "drop_rows_with_missing_values"
METHOD_NONE = "no_missing_values_found"


def _dt(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def project(df: DataFrame, spec: TableSpec, keep_key: bool = False) -> DataFrame:
    """Features then target, in the fixed order; error on a missing column."""
    cols = ([spec.key] if keep_key and spec.key else []) + spec.columns
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*cols)


def blank_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Blank / whitespace-only strings become null (string columns only)."""
    cols = [c for c in (columns or df.columns) if isinstance(_dt(df, c), T.StringType)]
    return df.withColumns({c: F.when(F.col(c).rlike(BLANK_RE), F.lit(None)).otherwise(F.col(c)) for c in cols})


def missing_row_mask(df: DataFrame, columns: Sequence[str]) -> Column:
    """Any null, NaN (floating) or blank string among ``columns``."""
    m = F.lit(False)
    for c in columns:
        dt = _dt(df, c)
        m = m | is_missing(c, dt)
        if isinstance(dt, T.StringType):
            m = m | F.coalesce(F.col(c).rlike(BLANK_RE), F.lit(False))
    return m


def drop_blank_and_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Blank -> null, then drop rows with a missing value in ``subset``."""
    return df.where(~missing_row_mask(df, subset))


def drop_incomplete_report(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Rows before/after and the method tag of the missing-value step."""
    m = missing_row_mask(df, subset)
    return df.agg(F.count(F.lit(1)).alias("n_before"), F.count_if(m).alias("n_missing_rows")).select(
        "n_before", "n_missing_rows", (F.col("n_before") - F.col("n_missing_rows")).alias("n_after"),
        F.when(F.col("n_missing_rows") > 0, F.lit(METHOD_DROPPED)).otherwise(F.lit(METHOD_NONE)).alias("method"))


def drop_duplicates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact duplicates removed; group members are identical, so any survivor is 'first'."""
    return df.dropDuplicates(list(columns) if columns else None)


def drop_out_of_bounds(df: DataFrame, spec: TableSpec) -> DataFrame:
    """One predicate = OR of every bounds rule (Q11) across features."""
    return df.where(~invalid_row_mask(df, spec))


def standardize_labels(df: DataFrame, spec: TableSpec, out: str | None = None) -> DataFrame:
    """Map known misspellings to the right spelling. The map is a literal ``create_map``
    (no join, stays in codegen)."""
    if not spec.label_fixes:
        return df
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in spec.label_fixes.items()))
    return df.withColumn(out or spec.target, F.coalesce(m[F.col(spec.target)], F.col(spec.target)))


def label_fix_report(df: DataFrame, spec: TableSpec) -> DataFrame:
    """C06 report: class distribution before and after the fix, rows changed per label."""
    fixed = standardize_labels(df.select(spec.target), spec, out="fixed")
    per = fixed.groupBy(spec.target, "fixed").agg(F.count(F.lit(1)).alias("c"))
    before = per.groupBy(F.col(spec.target).alias("label")).agg(F.sum("c").alias("n_before"))
    after = per.groupBy(F.col("fixed").alias("label")).agg(F.sum("c").alias("n_after"))
    changed = per.where(F.col(spec.target) != F.col("fixed")).groupBy(F.col(spec.target).alias("label")) \
        .agg(F.sum("c").alias("n_changed"))
    j = before.join(after, "label", "full_outer").join(changed, "label", "left")  # k rows each
    return j.where(F.col("label").isNotNull()).select(
        "label", F.coalesce("n_before", F.lit(0)).cast("bigint").alias("n_before"),
        F.coalesce("n_after", F.lit(0)).cast("bigint").alias("n_after"),
        F.coalesce("n_changed", F.lit(0)).cast("bigint").alias("n_changed"))


def lineage(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows before / removed / after for missing -> duplicates -> bounds, from one
    ``groupBy`` over the used columns. Each group carries its multiplicity; missing and
    bounds flags depend only on the group key, and a surviving duplicate group keeps exactly
    one row, so every stage count follows from the grouped table."""
    used = spec.columns
    groups = df.groupBy(*used).agg(F.count(F.lit(1)).alias("c"))
    miss = missing_row_mask(groups, used)
    bad = invalid_row_mask(groups, spec)
    s = groups.agg(
        F.sum("c").alias("n0"),
        F.coalesce(F.sum(F.when(miss, F.col("c"))), F.lit(0)).alias("r1"),
        F.count_if(~miss).alias("g"),
        F.count_if(~miss & bad).alias("r3"))
    n1 = F.col("n0") - F.col("r1")
    def stage(step, name, before, removed, after):
        return F.struct(F.lit(step).alias("step"), F.lit(name).alias("stage"), before.alias("n_before"),
                        removed.alias("n_removed"), after.alias("n_after"))
    rows = F.array(
        stage(1, "missing_values", F.col("n0"), F.col("r1"), n1),
        stage(2, "duplicates", n1, n1 - F.col("g"), F.col("g")),
        stage(3, "bounds", F.col("g"), F.col("r3"), F.col("g") - F.col("r3")),
    )
    out = s.select(F.inline(rows))
    return out.select("step", "stage", *[F.col(c).cast("bigint").alias(c) for c in ("n_before", "n_removed", "n_after")])


def lineage_with_labels(df: DataFrame, spec: TableSpec) -> DataFrame:
    """C07 in the order of the second workflow: missing -> duplicates -> label standardisation, with the method of each step and
    its details (JSON): missing cells per column, rows per corrected label. From one ``groupBy`` over the used columns."""
    used = spec.columns
    groups = df.groupBy(*used).agg(F.count(F.lit(1)).alias("c"))
    miss = missing_row_mask(groups, used)
    cells = {u: missing_row_mask(groups, [u]) for u in used}
    fixes = sorted(spec.label_fixes)
    s = groups.agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n0"), F.coalesce(F.sum(F.when(miss, F.col("c"))), F.lit(0)).alias("r1"),
        F.count_if(~miss).alias("g"),
        *[F.coalesce(F.sum(F.when(m, F.col("c"))), F.lit(0)).alias(f"m{i}") for i, m in enumerate(cells.values())],
        *[F.count_if(~miss & (F.col(spec.target) == w)).alias(f"w{i}") for i, w in enumerate(fixes)])

    def text(names: Sequence[str], cols: Sequence[str]) -> F.Column:
        pairs = [F.concat(F.lit(json.dumps(str(n), ensure_ascii=False) + ": "), F.col(c).cast("string")) for n, c in zip(names, cols)]
        return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))

    fixed = sum((F.col(f"w{i}") for i in range(len(fixes))), F.lit(0))
    n1 = F.col("n0") - F.col("r1")

    def stage(step, name, before, removed, changed, method, details):
        return F.struct(F.lit(step).alias("step"), F.lit(name).alias("stage"), before.cast("bigint").alias("n_before"),
                        removed.cast("bigint").alias("n_removed"), (before - removed).cast("bigint").alias("n_after"),
                        changed.cast("bigint").alias("n_changed"), method.alias("method"), details.alias("details"))

    rows = F.array(
        stage(1, "missing_values", F.col("n0"), F.col("r1"), F.lit(0),
              F.when(F.col("r1") > 0, F.lit("drop_rows_with_missing_values")).otherwise(F.lit("no_missing_values_found")),
              text(used, [f"m{i}" for i in range(len(used))])),
        stage(2, "duplicates", n1, n1 - F.col("g"), F.lit(0), F.lit("keep_first_occurrence"), F.lit("{}")),
        stage(3, "label_standardization", F.col("g"), F.lit(0), fixed, F.lit("map_known_spellings"), text(fixes, [f"w{i}" for i in range(len(fixes))])))
    return s.select(F.inline(rows))


def clean(df: DataFrame, spec: TableSpec) -> DataFrame:
    """The cleaning plan as one lazy chain: project, drop missing, dedup, drop out-of-bounds,
    standardise labels (dedup before the label fix, as the reference does)."""
    p = project(df, spec)
    p = drop_blank_and_missing(p, spec.columns)
    p = drop_duplicates(p)
    p = drop_out_of_bounds(p, spec) if spec.bounds else p
    return standardize_labels(p, spec)


def derived_columns(df: DataFrame) -> DataFrame:
    """Percent, equality flag, absolute value and ratio columns on lineitem."""
    return df.withColumns({
        "discount_pct": F.col("l_discount") * 100.0,
        "flag_equals_status": F.col("l_returnflag") == F.col("l_linestatus"),
        "abs_net_change": F.abs(F.col("l_extendedprice") * (F.col("l_tax") - F.col("l_discount"))),
        "tax_to_net_ratio": F.when(F.col("l_discount") != 1, F.col("l_tax") / (1 - F.col("l_discount"))),
    })
