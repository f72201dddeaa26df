"""Contract and data-quality operators (Q01–Q18).

Schema checks read only metadata (``df.schema``); value checks are one aggregate pass each,
turned into rows with ``inline``. Row validation (Q18) is a pure projection, so it streams
and scales linearly; good and quarantined rows are two filters of the same plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.functions.exprs import is_blank, is_missing, is_numeric, strict_number
from labeltab.operators.inventory import row_keys
from labeltab.operators.profile import dataset_profile
from labeltab.spec import TableSpec


def _dt(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


# ---- Q01–Q04 schema ---------------------------------------------------------------------------

def schema_contract(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Q01: ordered column equality, one row per position."""
    actual = list(df.columns)
    n = max(len(actual), len(expected))
    rows = [(i, expected[i] if i < len(expected) else None, actual[i] if i < len(actual) else None)
            for i in range(n)]
    out = df.sparkSession.createDataFrame(rows, "position int, expected_column string, actual_column string")
    return out.withColumn("matches", F.coalesce(F.col("expected_column") == F.col("actual_column"), F.lit(False)))


def require_schema(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Q01 as a gate: raise when the ordered column list differs."""
    if list(df.columns) != list(expected):
        raise ValueError(f"schema mismatch: expected {list(expected)}, found {df.columns}")
    return df


def required_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Q02: each required column and whether it is present."""
    have = set(df.columns)
    rows = [(c, c in have) for c in required]
    return df.sparkSession.createDataFrame(rows, "column_name string, present boolean")


def non_empty(tables: dict[str, DataFrame]) -> DataFrame:
    """Q03: ``limit(1)`` per table — reads at most one row group each."""
    parts = [df.limit(1).agg(F.count(F.lit(1)).alias("c")).select(F.lit(name).alias("table_name"),
                                                                    (F.col("c") == 0).alias("is_empty"))
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def type_kinds(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Q04: features must be numeric and the target a string."""
    rows = []
    for c in spec.columns:
        dt = _dt(df, c)
        kind = "numeric" if is_numeric(dt) else ("string" if isinstance(dt, T.StringType) else dt.simpleString())
        want = "string" if c == spec.target else "numeric"
        rows.append((c, kind, want, "OK" if kind == want else "INVALID"))
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string, expected_kind string, status string")


# ---- Q05–Q10 profiles and missing values -------------------------------------------------------

def table_profile(df: DataFrame, spec: TableSpec, name: str) -> DataFrame:
    """Q05: rows, columns, duplicate rows, missing cells in used columns, classes."""
    return dataset_profile(df, spec, name).withColumnRenamed("dataset", "table_name")


def missing_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q06–Q08: null (or NaN) count, blank-string count and their sum per column, plus a
    ``_total`` row — one aggregate pass."""
    cols = list(columns or df.columns)
    aggs = []
    for i, c in enumerate(cols):
        dt = _dt(df, c)
        aggs.append(F.count_if(is_missing(c, dt)).alias(f"n{i}"))
        aggs.append((F.count_if(is_blank(c)) if isinstance(dt, T.StringType) else F.lit(0)).alias(f"b{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").cast("bigint").alias("n_null"),
                     F.col(f"b{i}").cast("bigint").alias("n_blank"),
                     (F.col(f"n{i}") + F.col(f"b{i}")).cast("bigint").alias("n_missing_like"))
            for i, c in enumerate(cols)]
    tn = sum((F.col(f"n{i}") for i in range(len(cols))), F.lit(0))
    tb = sum((F.col(f"b{i}") for i in range(len(cols))), F.lit(0))
    rows.append(F.struct(F.lit("_total").alias("column_name"), tn.cast("bigint").alias("n_null"),
                         tb.cast("bigint").alias("n_blank"), (tn + tb).cast("bigint").alias("n_missing_like")))
    return one.select(F.inline(F.array(*rows)))


def numeric_validity(df: DataFrame, features: Sequence[str], n_examples: int = 5) -> DataFrame:
    """Q09: per feature, values that parse to NaN, to +-inf, and present values that do not
    parse, with up to ``n_examples`` smallest distinct unparseable values. The examples come
    from a top-k (``orderBy().limit()``, bounded per partition), never a collected set."""
    aggs, ex = [], []
    for i, f in enumerate(features):
        dt = _dt(df, f)
        raw = F.col(f)
        num = strict_number(raw) if not is_numeric(dt) else raw.cast("double")
        bad = raw.isNotNull() & ~is_blank(raw.cast("string")) & num.isNull() if not is_numeric(dt) else F.lit(False)
        aggs += [F.count_if(F.isnan(num)).alias(f"nan{i}"), F.count_if(num.isin(float("inf"), float("-inf"))).alias(f"inf{i}"),
                 F.count_if(bad).alias(f"bad{i}")]
        if not is_numeric(dt):
            ex.append(df.where(bad).select(F.lit(f).alias("feature"), raw.alias("v")).distinct()
                      .orderBy("v").limit(n_examples))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"nan{i}").cast("bigint").alias("n_nan"),
                     F.col(f"inf{i}").cast("bigint").alias("n_inf"), F.col(f"bad{i}").cast("bigint").alias("n_invalid"))
            for i, f in enumerate(features)]
    counts = one.select(F.inline(F.array(*rows)))
    if not ex:
        return counts.withColumn("examples", F.lit(""))
    u = ex[0]
    for e in ex[1:]:
        u = u.unionByName(e)
    got: dict[str, list[str]] = {}
    for r in u.collect():  # at most n_examples rows per feature
        got.setdefault(r["feature"], []).append(r["v"])
    text = {f: ",".join(sorted(v)) for f, v in got.items()}
    lookup = F.create_map(*[x for f in features for x in (F.lit(f), F.lit(text.get(f, "")))])
    return counts.withColumn("examples", F.coalesce(lookup[F.col("feature")], F.lit("")))


def finite_gate(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Q10: every value present and finite, per feature and overall (``*``)."""
    aggs = []
    for i, f in enumerate(features):
        v = F.col(f).cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))
        aggs.append(F.coalesce(F.bool_and(ok), F.lit(True)).alias(f"g{i}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("feature"), F.col(f"g{i}").alias("all_finite")) for i, f in enumerate(features)]
    allok = F.lit(True)
    for i in range(len(features)):
        allok = allok & F.col(f"g{i}")
    rows.append(F.struct(F.lit("*").alias("feature"), allok.alias("all_finite")))
    return one.select(F.inline(F.array(*rows)))


# ---- Q11 bounds ----------------------------------------------------------------------------

def parsed(df: DataFrame, f: str) -> tuple[Column, Column]:
    """(numeric value, non-numeric flag) with pandas ``to_numeric(errors='coerce')`` rules:
    for text columns a present value that parses to null or NaN is non-numeric."""
    dt = _dt(df, f)
    raw = F.col(f)
    if is_numeric(dt):
        return raw.cast("double"), F.lit(False)
    num = strict_number(raw)
    return num, raw.isNotNull() & (num.isNull() | F.isnan(num))


def bounds_masks(df: DataFrame, spec: TableSpec) -> dict[str, dict[str, Column]]:
    """Per feature: rule name -> boolean mask. NaN never passes a bound test (guarded)."""
    out = {}
    for f in spec.features:
        num, non_numeric = parsed(df, f)
        ok = num.isNotNull() & ~F.isnan(num)
        lo, hi = spec.bounds.get(f, (None, None))
        rules = {"non_numeric": non_numeric}
        if lo is not None:
            rules["below_min"] = ok & (num < F.lit(float(lo)))
        if hi is not None:
            rules["above_max"] = ok & (num > F.lit(float(hi)))
        rules["infinite"] = ok & num.isin(float("inf"), float("-inf"))
        out[f] = rules
    return out


def invalid_row_mask(df: DataFrame, spec: TableSpec) -> Column:
    """OR of every bounds rule of every feature (C05's predicate; each mask defined once)."""
    m = F.lit(False)
    for rules in bounds_masks(df, spec).values():
        for c in rules.values():
            m = m | c
    return m


def bounds_rule_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Q11: (feature, rule, n); a rule row exists only when its bound is configured."""
    masks = bounds_masks(df, spec)
    aggs, rows = [], []
    for i, (f, rules) in enumerate(masks.items()):
        for j, (rule, m) in enumerate(rules.items()):
            aggs.append(F.count_if(m).alias(f"c{i}_{j}"))
            rows.append(F.struct(F.lit(f).alias("feature"), F.lit(rule).alias("rule"),
                                 F.col(f"c{i}_{j}").cast("bigint").alias("n")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


# ---- Q12–Q13 duplicates ------------------------------------------------------------------------

def duplicate_count(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Q12: rows beyond the first occurrence (null and NaN group as equal, as in pandas), by row digests."""
    cols = list(columns or df.columns)
    return (df.groupBy(*row_keys(df, cols)).count()
            .agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n_duplicates")))


def duplicate_listing(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Q13: every member of every duplicate group with the group size. Group sizes come from a
    partially-aggregated ``groupBy``; members are found by a null-safe join back, which AQE
    splits when one group is huge (no window holds a whole group in one task)."""
    sizes = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    s = sizes.alias("s")
    d = df.select(key, *columns).alias("d")
    cond = None
    for c in columns:
        e = F.col(f"d.{c}").eqNullSafe(F.col(f"s.{c}"))
        cond = e if cond is None else cond & e
    return d.join(s, cond).select(F.col(f"d.{key}").alias("key"), *[F.col(f"d.{c}").alias(c) for c in columns],
                                  F.col("s.group_size").cast("bigint").alias("group_size"))


def duplicate_positions(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Q13 on Parquet files: every member of every duplicate group with its place in the table, files in the order of their
    names: ``position`` from 0 and ``line_number`` = position + 2 (a header line before it). Places come from the files' own row
    numbers plus the rows of the files before (one row a file), not from a sort of the rows."""
    rows = spark.read.parquet(path).select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = rows.groupBy("__file").agg(F.count(F.lit(1)).alias("n")).withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    placed = rows.join(files.select("__file", "__before"), "__file").withColumn("position", (F.col("__before") + F.col("__row")).cast("bigint"))
    return (duplicate_listing(placed, columns, "position").withColumnRenamed("key", "position")
            .withColumn("line_number", F.col("position") + 2))


def numeric_report(df: DataFrame, features: Sequence[str], n_examples: int = 5) -> DataFrame:
    """Q09 as the reference counts: ``nan_count`` = null or NaN, ``infinite_count`` (0 for text columns),
    ``invalid_string_count`` = present text that is no number (blanks and spelled NaN included) with up to
    ``n_examples`` smallest distinct examples, and ``valid``: a numeric column without any of them. One row a feature."""
    out = None
    for f in features:
        dt, raw = _dt(df, f), F.col(f"`{f}`")
        numeric = is_numeric(dt)
        num = raw.cast("double") if numeric else strict_number(raw.cast("string"))
        bad = F.lit(False) if numeric else raw.isNotNull() & (num.isNull() | F.isnan(num))
        counts = df.agg(F.count_if(is_missing(f, dt)).alias("nan_count"),
                        F.count_if(F.lit(numeric) & num.isin(float("inf"), float("-inf"))).alias("infinite_count"), F.count_if(bad).alias("invalid_string_count"))
        one = counts.select(F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("string").alias("v")) for m in counts.columns])))
        some = (df.where(bad).select(raw.cast("string").alias("v")).distinct().orderBy("v").limit(n_examples)
                .agg(F.array_join(F.sort_array(F.collect_list("v")), ",").alias("v")).select(F.lit("examples").alias("m"), "v"))
        row = one.unionByName(some).groupBy().pivot("m", ["nan_count", "infinite_count", "invalid_string_count", "examples"]).agg(F.first("v"))
        n = {c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in counts.columns}
        row = row.select(F.lit(f).alias("feature"), F.lit(dt.simpleString()).alias("dtype"), F.lit(numeric).alias("is_numeric"),
                         n["nan_count"].alias("nan_count"), n["infinite_count"].alias("infinite_count"),
                         n["invalid_string_count"].alias("invalid_string_count"), F.coalesce("examples", F.lit("")).alias("examples"),
                         (F.lit(numeric) & (n["nan_count"] == 0) & (n["infinite_count"] == 0)).alias("valid"))
        out = row if out is None else out.unionByName(row)
    return out


# ---- Q14–Q17 checklists ----------------------------------------------------------------------

def checklist(df: DataFrame, spec: TableSpec, expected_columns: Sequence[str]) -> DataFrame:
    """Q14: named checks as (check_name, passed) plus an overall ``status`` row. One aggregate
    over the table and one ``groupBy`` for duplicates."""
    dt = {c: _dt(df, c) for c in spec.columns}
    fin = F.lit(True)
    for f in spec.features:
        v = F.col(f).cast("double")
        fin = fin & v.isNotNull() & ~F.isnan(v) & ~v.isin(float("inf"), float("-inf"))
    miss = F.lit(False)
    for c in spec.columns:
        miss = miss | is_missing(c, dt[c])
    classes = list(spec.expected_classes or [])
    one = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(miss).alias("miss"),
                 F.coalesce(F.bool_and(fin), F.lit(True)).alias("fin"),
                 F.count_distinct(spec.target).alias("k"),
                 F.count_if(~F.col(spec.target).isin(classes)).alias("unexpected"))
    dups = duplicate_count(df)
    checks = {
        "has_rows": F.col("n") > 0,
        "schema_matches": F.lit(list(df.columns) == list(expected_columns)),
        "no_missing_in_used_columns": F.col("miss") == 0,
        "features_finite": F.col("fin"),
        "class_count_matches": F.col("k") == len(classes),
        "labels_in_domain": F.col("unexpected") == 0,
    }
    base = one.select(*[v.alias(k) for k, v in checks.items()])
    long = base.select(F.inline(F.array(*[F.struct(F.lit(k).alias("check_name"), F.col(k).alias("passed"))
                                          for k in checks])))
    long = long.unionByName(dups.select(F.lit("no_duplicate_rows").alias("check_name"),
                                        (F.col("n_duplicates") == 0).alias("passed")))
    status = long.agg(F.bool_and("passed").alias("passed")).select(F.lit("status").alias("check_name"), "passed")
    return long.unionByName(status)


def split_shape(split_df: DataFrame, test_fraction: float = 0.2) -> DataFrame:
    """Q15: rows per split against ``n_test = ceil(f * n)``, ``n_train = n - n_test``."""
    counts = split_df.groupBy("split").agg(F.count(F.lit(1)).alias("actual"))
    tot = F.sum("actual").over(Window.partitionBy())  # two aggregated rows
    n_test = F.ceil(tot * F.lit(test_fraction))
    exp = F.when(F.col("split") == "test", n_test).otherwise(tot - n_test)
    return counts.select("split", exp.cast("bigint").alias("expected"), F.col("actual").cast("bigint"),
                         (exp == F.col("actual")).alias("passed"))


def class_domain(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Q16: observed distinct labels full-outer-joined with the expected list."""
    spark = df.sparkSession
    seen = df.where(F.col(spec.target).isNotNull()).select(F.col(spec.target).cast("string").alias("label")).distinct() \
        .withColumn("in_data", F.lit(True))
    exp = spark.createDataFrame([(str(c),) for c in (spec.expected_classes or [])], "label string") \
        .withColumn("in_expected", F.lit(True))
    j = seen.join(exp, "label", "full_outer")
    return j.select("label", F.coalesce("in_data", F.lit(False)).alias("in_data"),
                    F.coalesce("in_expected", F.lit(False)).alias("in_expected")) \
        .withColumn("matches", F.col("in_data") & F.col("in_expected"))


def encoded_range(split_df: DataFrame, code: str = "code") -> DataFrame:
    """Q17: codes span exactly 0..k-1 in each split."""
    return split_df.groupBy("split").agg(
        F.min(code).cast("int").alias("min_code"), F.max(code).cast("int").alias("max_code"),
        F.count_distinct(code).cast("bigint").alias("n_codes")) \
        .withColumn("passed", (F.col("min_code") == 0) & (F.col("max_code") == F.col("n_codes") - 1))


# ---- Q18 row validation ------------------------------------------------------------------------

# Row-validation message templates, in check order.
MSG_NOT_NUMERIC = "{f} must be numeric."
MSG_NAN = "{f} cannot be NaN."
MSG_INFINITE = "{f} cannot be infinite."
MSG_BELOW_MIN = "{f} must be greater than or equal to {b}."
MSG_ABOVE_MAX = "{f} must be less than or equal to {b}."
MSG_MISSING = "Missing required input(s): {names}"


def _fmt_g(x: float) -> str:
    return format(float(x), "g")


def validate_rows(df: DataFrame, spec: TableSpec, check_bounds: bool = True) -> DataFrame:
    """Q18: every message for every row, in feature order. Per feature: unparseable (or
    missing) -> only 'must be numeric'; else NaN -> only 'cannot be NaN'; else infinite ->
    only 'cannot be infinite'; else both bound checks. Adds ``errors`` (array),
    ``n_errors`` and ``is_valid``; valid and invalid rows are ``where`` filters of this."""
    missing = [f for f in spec.features if f not in df.columns]
    if missing:
        raise ValueError(MSG_MISSING.format(names=", ".join(missing)))
    msgs = []
    for f in spec.features:
        dt = _dt(df, f)
        raw = F.col(f)
        num = raw.cast("double") if is_numeric(dt) else strict_number(raw)
        unparsed = num.isNull()
        is_nan = F.isnan(num)
        is_inf = num.isin(float("inf"), float("-inf"))
        msgs.append(F.when(unparsed, F.lit(MSG_NOT_NUMERIC.format(f=f)))
                    .when(is_nan, F.lit(MSG_NAN.format(f=f)))
                    .when(is_inf, F.lit(MSG_INFINITE.format(f=f))))
        lo, hi = spec.bounds.get(f, (None, None)) if check_bounds else (None, None)
        finite = ~unparsed & ~is_nan & ~is_inf
        if lo is not None:
            msgs.append(F.when(finite & (num < F.lit(float(lo))),
                               F.lit(MSG_BELOW_MIN.format(f=f, b=_fmt_g(lo)))))
        if hi is not None:
            msgs.append(F.when(finite & (num > F.lit(float(hi))),
                               F.lit(MSG_ABOVE_MAX.format(f=f, b=_fmt_g(hi)))))
    errors = F.filter(F.array(*msgs), lambda x: x.isNotNull())
    return (df.withColumn("errors", errors)
            .withColumn("n_errors", F.size("errors").cast("int"))
            .withColumn("is_valid", F.col("n_errors") == 0))


def validation_report(df: DataFrame, spec: TableSpec) -> DataFrame:
    v = validate_rows(df, spec)
    return v.select(F.col(spec.key).alias("row_id"), "is_valid", "n_errors",
                    F.array_join("errors", "; ").alias("errors"))
