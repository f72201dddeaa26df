"""Feature-relevance and separability operators.

Each one reduces the data first — per-class moments, a (feature, bin, class) or
(feature, value, class) contingency with map-side partial aggregation — and then finishes on
the small aggregated table (k classes x f features). Nothing row-sized reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.functions.exprs import clean_number, is_missing
from labeltab.functions.ranked import ranked, running
from labeltab.spec import TableSpec


# Granularity assessment labels (the few-distinct-values rule is our own).
GRAIN_INTEGER = "discretized/integer-valued"
GRAIN_FEW = "discretized (few distinct values)"
GRAIN_ROUNDED = "continuous-looking but rounded to <=2 decimals"
GRAIN_CONTINUOUS = "continuous"


def _dt(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def _long_values(df: DataFrame, spec: TableSpec, feats: Sequence[str]) -> DataFrame:
    """(feature, value, label) for present values and labels. ``inline`` runs inside the scan
    pipeline, so the explode is never materialised before the partial aggregate that follows."""
    lab = df.where(~is_missing(spec.target, _dt(df, spec.target)))
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), clean_number(f, _dt(df, f)).alias("value"))
                    for f in feats])
    return (lab.select(F.col(spec.target).alias("label"), F.inline(arr))
            .where(F.col("value").isNotNull()))


# ---- R01–R04 one-way ANOVA ------------------------------------------------------------------

def class_moments(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, label, n, mean, var, std) — one grouped pass over the data."""
    feats = list(features or spec.features)
    lab = df.where(~is_missing(spec.target, _dt(df, spec.target)))
    aggs = []
    for i, f in enumerate(feats):
        v = clean_number(f, _dt(df, f))
        aggs += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_samp(v).alias(f"v{i}")]
    wide = lab.groupBy(F.col(spec.target).alias("label")).agg(*aggs)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"n{i}").alias("n"),
                             F.col(f"m{i}").alias("mean"), F.col(f"v{i}").alias("var"))
                    for i, f in enumerate(feats)])
    return (wide.select("label", F.inline(arr)).where(F.col("n") > 0)
            .withColumn("std", F.sqrt("var")))


def anova(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """R01 F statistic, R03 eta squared, R04 class-mean range (raw and divided by the mean of
    class sample standard deviations). SSB uses the centred form sum n_c (m_c - M)^2, which
    keeps precision when class means nearly coincide."""
    mom = class_moments(df, spec, features)
    w = Window.partitionBy("feature")  # k rows per feature
    grand = F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w)
    t = mom.withColumn("grand", grand)
    agg = t.groupBy("feature").agg(
        F.count(F.lit(1)).cast("bigint").alias("k"), F.sum("n").cast("bigint").alias("n"),
        F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("ssb"),
        F.sum(F.coalesce((F.col("n") - 1) * F.col("var"), F.lit(0.0))).alias("ssw"),
        (F.max("mean") - F.min("mean")).alias("mean_range"), F.avg("std").alias("mean_std"))
    return agg.select(
        "feature", "k", "n",
        F.when((F.col("k") > 1) & (F.col("n") > F.col("k")) & (F.col("ssw") > 0),
               (F.col("ssb") / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))).alias("f_stat"),
        F.when(F.col("ssb") + F.col("ssw") > 0, F.col("ssb") / (F.col("ssb") + F.col("ssw"))).alias("eta_squared"),
        F.col("mean_range"),
        F.when(F.col("mean_std") > 0, F.col("mean_range") / F.col("mean_std")).alias("normalized_mean_range"),
    )


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 100000):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def f_survival(f: float, d1: float, d2: float) -> float:
    """P(F(d1, d2) > f)."""
    if f is None or d1 <= 0 or d2 <= 0 or np.isnan(f):
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(T.DoubleType())
def _f_pvalue_udf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_survival(a, b, c) if a is not None and not pd.isna(a) else float("nan")
                      for a, b, c in zip(f, d1, d2)], dtype="float64")


def anova_pvalue(anova_df: DataFrame) -> DataFrame:
    """Survival function of F(k-1, n-k); a per-row helper on the per-feature result."""
    return anova_df.select("feature", "f_stat", (F.col("k") - 1).alias("df_between"),
                           (F.col("n") - F.col("k")).alias("df_within")) \
        .withColumn("p_value", _f_pvalue_udf(F.col("f_stat"), F.col("df_between").cast("double"),
                                             F.col("df_within").cast("double")))


# ---- R05 mutual information (binned plug-in estimator) ------------------------------------

def mutual_information(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None,
                       bins: int = 20) -> DataFrame:
    """MI (nats) between an equal-width-binned feature and the class. The reference's
    nearest-neighbour estimator is replaced by this plug-in estimator by design."""
    feats = list(features or spec.features)
    mm = df.agg(*[F.min(clean_number(f, _dt(df, f))).alias(f"a{i}") for i, f in enumerate(feats)],
                *[F.max(clean_number(f, _dt(df, f))).alias(f"b{i}") for i, f in enumerate(feats)]).first()
    lab = df.where(~is_missing(spec.target, _dt(df, spec.target)))
    structs = []
    for i, f in enumerate(feats):
        lo, hi = mm[f"a{i}"], mm[f"b{i}"]
        v = clean_number(f, _dt(df, f))
        width = (hi - lo) if lo is not None and hi > lo else None
        b = (F.least(F.floor((v - F.lit(lo)) / F.lit(width) * bins), F.lit(bins - 1)) if width
             else F.lit(0)).cast("int")
        structs.append(F.struct(F.lit(f).alias("feature"), F.when(v.isNotNull(), b).alias("bin")))
    cont = (lab.select(F.col(spec.target).alias("label"), F.inline(F.array(*structs)))
            .where(F.col("bin").isNotNull())
            .groupBy("feature", "bin", "label").agg(F.count(F.lit(1)).alias("nxy")))
    wf = Window.partitionBy("feature")
    cont = cont.withColumn("nxy", F.col("nxy").cast("double"))  # products of counts overflow bigint at scale
    t = (cont.withColumn("n", F.sum("nxy").over(wf))
         .withColumn("nx", F.sum("nxy").over(Window.partitionBy("feature", "bin")))
         .withColumn("ny", F.sum("nxy").over(Window.partitionBy("feature", "label"))))
    return t.groupBy("feature").agg(
        F.sum(F.col("nxy") / F.col("n") * F.log(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))).alias("mi"))


# ---- R06–R09 categorical relevance ----------------------------------------------------------

def contingency(df: DataFrame, spec: TableSpec, categories: Sequence[str]) -> DataFrame:
    """(category_col, category, label, n) for every observed cell, one scan for all columns."""
    lab = df.where(~is_missing(spec.target, _dt(df, spec.target)))
    arr = F.array(*[F.struct(F.lit(c).alias("category_col"), F.col(c).cast("string").alias("category"))
                    for c in categories])
    return (lab.select(F.col(spec.target).alias("label"), F.inline(arr))
            .where(F.col("category").isNotNull())
            .groupBy("category_col", "category", "label").agg(F.count(F.lit(1)).alias("n")))



def categorical_relevance(df: DataFrame, spec: TableSpec, categories: Sequence[str]) -> DataFrame:
    """R06 Pearson chi-square and dof, R07 bias-corrected Cramér's V, R08 MI / H(target),
    R09 maximum category purity and largest category size. Zero cells are never enumerated:
    chi2 = sum O^2/E - n over the observed cells."""
    c = contingency(df, spec, categories).withColumn("n", F.col("n").cast("double"))
    # totals by partial aggregation and joined back: a window over a column would put all its cells into one task
    total = c.groupBy("category_col").agg(F.sum("n").alias("tot"))
    by_label = c.groupBy("category_col", "label").agg(F.sum("n").alias("nj")).join(total, "category_col")
    t = (c.join(c.groupBy("category_col", "category").agg(F.sum("n").alias("ni")), ["category_col", "category"])
         .join(by_label, ["category_col", "label"]))
    cells = t.groupBy("category_col").agg(
        F.first("tot").alias("tot"),  # identical on every row of the group
        F.count_distinct("category").alias("r"), F.count_distinct("label").alias("c"),
        (F.sum(F.col("n") * F.col("n") * F.col("tot") / (F.col("ni") * F.col("nj"))) - F.first("tot")).alias("chi2"),
        F.sum(F.col("n") / F.col("tot") * F.log(F.col("n") * F.col("tot") / (F.col("ni") * F.col("nj")))).alias("mi"),
        F.max(F.col("n") / F.col("ni")).alias("max_purity"),
        F.max("ni").cast("bigint").alias("largest_category_n"))
    ent = (by_label.groupBy("category_col").agg((-F.sum(F.col("nj") / F.col("tot") * F.log(F.col("nj") / F.col("tot")))).alias("h_target")))
    j = cells.join(ent, "category_col")  # one row per category column on each side
    n, r, k = F.col("tot"), F.col("r"), F.col("c")
    phi2c = F.greatest(F.lit(0.0), F.col("chi2") / n - (k - 1) * (r - 1) / (n - 1))
    rc = r - (r - 1) ** 2 / (n - 1)
    kc = k - (k - 1) ** 2 / (n - 1)
    denom = F.least(kc - 1, rc - 1)
    return j.select(
        "category_col", F.col("chi2"), ((r - 1) * (k - 1)).cast("bigint").alias("dof"),
        F.when(denom > 0, F.sqrt(phi2c / denom)).otherwise(F.lit(0.0)).alias("cramers_v"),
        F.when(F.col("h_target") > 0, F.col("mi") / F.col("h_target")).otherwise(F.lit(0.0)).alias("nmi_target"),
        "max_purity", "largest_category_n")


def chi2_tail(x: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(chi-square(dof) > x): the regularised upper incomplete gamma function Q(dof / 2, x / 2), by its power series
    below a + 1 and its continued fraction above."""
    out = np.full(len(x), np.nan)
    for i, (chi2, d) in enumerate(zip(x, dof)):
        a, z = d / 2, chi2 / 2
        if not (d > 0 and z >= 0):
            continue
        if z == 0 or math.isinf(z):
            out[i] = 0.0 if z else 1.0
            continue
        scale = math.exp(a * math.log(z) - z - math.lgamma(a))
        if z < a + 1:
            term = total = 1 / a
            n = a
            while term > total * 1e-17:
                n += 1
                term *= z / n
                total += term
            out[i] = 1 - scale * total
        else:
            b = z + 1 - a  # Lentz's form of the continued fraction
            c, d_ = 1e300, 1 / b
            f = d_
            for k in range(1, 10_000):
                an = -k * (k - a)
                b += 2
                d_ = 1 / (an * d_ + b)
                c = b + an / c
                f *= c * d_
                if abs(c * d_ - 1) < 1e-16:
                    break
            out[i] = scale * f
    return np.clip(out, 0, 1)


@F.pandas_udf(T.DoubleType())
def _chi2_tail_udf(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series(chi2_tail(x.to_numpy(float), dof.to_numpy(float)))


def chi_square_pvalue(relevance: DataFrame) -> DataFrame:
    """Upper tail of the chi-square distribution for each row of ``categorical_relevance``; NaN without freedom."""
    return relevance.select("category_col", "chi2", "dof", _chi2_tail_udf(F.col("chi2"), F.col("dof").cast("double")).alias("p_value"))


# ---- R10–R12 class ranges -------------------------------------------------------------------

def class_bounds(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """(feature, label, min, max, n) per class: one wide aggregate, unpivoted afterwards (k x f rows).
    Classes without a value of a feature have no row for it."""
    feats = list(features or spec.features)
    aggs = []
    for i, f in enumerate(feats):
        v = clean_number(f, _dt(df, f))
        aggs += [F.min(v).alias(f"a{i}"), F.max(v).alias(f"b{i}"), F.count(v).alias(f"n{i}")]
    wide = (df.where(~is_missing(spec.target, _dt(df, spec.target)))
            .groupBy(F.col(spec.target).alias("label")).agg(*aggs))
    cells = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"a{i}").alias("min"), F.col(f"b{i}").alias("max"),
                               F.col(f"n{i}").alias("n")) for i, f in enumerate(feats)])
    return wide.select("label", F.inline(cells)).where("n > 0").select("feature", "label", "min", "max", "n")


def class_ranges(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None,
                 tolerance: int = 0) -> DataFrame:
    """R10 per-class [min, max] and the number of other-class rows inside it; R11 ``exclusive``
    when that number is <= ``tolerance``. One scan: rows inside = rows up to max - rows below min, from running
    counts over the sorted distinct values; the class's own rows are subtracted."""
    by_class = running(ranked(_long_values(df, spec, list(features or spec.features)))).groupBy("feature", "label")
    per = by_class.agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("n").alias("n"),
                       F.max_by("upto", "value").alias("upto"), F.min_by("below", "value").alias("below"))
    return (per.select("feature", "label", "min", "max", "n",
                       (F.col("upto") - F.col("below") - F.col("n")).cast("bigint").alias("n_other_inside"))
            .withColumn("exclusive", F.col("n_other_inside") <= tolerance))


def range_overlaps(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """Every unordered class pair per feature — overlap flag (touching counts), overlap
    interval, width and width as percent of the smaller range (0 when that range is 0).
    A self join of the k x f bounds table, not of data rows; both sides are the same aggregate."""
    bounds = class_bounds(df, spec, features)
    a = bounds.select("feature", F.col("label").alias("class_a"), F.col("min").alias("a_min"), F.col("max").alias("a_max"))
    b = bounds.select(F.col("feature").alias("fb"), F.col("label").alias("class_b"), F.col("min").alias("b_min"), F.col("max").alias("b_max"))
    j = a.join(b, (a["feature"] == b["fb"]) & (a["class_a"] < b["class_b"]))
    overlap = (F.col("a_min") <= F.col("b_max")) & (F.col("b_min") <= F.col("a_max"))
    lo = F.when(overlap, F.greatest("a_min", "b_min"))
    hi = F.when(overlap, F.least("a_max", "b_max"))
    width = F.coalesce(hi - lo, F.lit(0.0))
    smaller = F.least(F.col("a_max") - F.col("a_min"), F.col("b_max") - F.col("b_min"))
    return j.select("class_a", "class_b", "feature", overlap.alias("overlap"), lo.alias("lo"), hi.alias("hi"),
                    width.alias("width"),
                    F.when(smaller > 0, width / smaller * 100.0).otherwise(F.lit(0.0)).alias("pct_of_smaller"))


# ---- R13 granularity, R14 redundancy, R15 label quality ------------------------------------

def granularity(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """Distinct values, repeated rows and values, per-class distinct counts (with the
    class -> count map as ordered JSON text), decimals observed, integer-likeness."""
    feats = list(features or spec.features)
    vals = _long_values(df, spec, feats).groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("cnt"))
    s = F.col("value").cast("string")
    digits = F.length(F.regexp_extract(s, r"\.([0-9]*?)0*(?:E|$)", 1))  # of the mantissa; the exponent moves them
    power = F.coalesce(F.nullif(F.regexp_extract(s, r"E(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
    decimals = F.when(F.abs("value") < float("inf"), F.greatest(digits - power, F.lit(0)))
    per_value = vals.groupBy("feature", "value").agg(F.sum("cnt").alias("c")).groupBy("feature").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_unique"), F.sum("c").cast("bigint").alias("n"),
        F.count_if(F.col("c") > 1).cast("bigint").alias("n_repeated_values"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.max(decimals).cast("int").alias("max_decimals"),
        F.bool_and(F.col("value") == F.floor("value")).alias("integer_like"))
    per_class = vals.groupBy("feature", "label").agg(F.count(F.lit(1)).alias("d")).groupBy("feature").agg(
        F.min("d").cast("bigint").alias("min_distinct"), F.max("d").cast("bigint").alias("max_distinct"),
        F.avg("d").alias("mean_distinct"),
        F.sort_array(F.collect_list(F.struct(F.col("label").cast("string").alias("l"), F.col("d")))).alias("m"))
    j = per_value.join(per_class, "feature")  # one row per feature on each side
    text = F.concat(F.lit("{"), F.array_join(F.transform("m", lambda x: F.concat(
        F.lit('"'), x["l"], F.lit('": '), x["d"].cast("string"))), ", "), F.lit("}"))
    rep_rows = F.col("n") - F.col("n_unique")
    assess = (F.when(F.col("integer_like"), F.lit(GRAIN_INTEGER))
              .when(F.col("n_unique") < F.col("n") * 0.05, F.lit(GRAIN_FEW))
              .when(F.col("max_decimals") <= 2, F.lit(GRAIN_ROUNDED))
              .otherwise(F.lit(GRAIN_CONTINUOUS)))
    return j.select("feature", "n_unique", rep_rows.alias("n_repeated_rows"), "n_repeated_values",
                    (rep_rows * 100.0 / F.col("n")).alias("repeated_pct"), "min", "max",
                    "min_distinct", "max_distinct", "mean_distinct", text.alias("distinct_by_class"),
                    "max_decimals", "integer_like", assess.alias("assessment"))


def scaled_copy_check(df: DataFrame, a: str, b: str, scale: float = 100.0, tol: float = 1e-12) -> DataFrame:
    """Is ``a`` equal to ``b / scale`` on every row?"""
    d = F.abs(F.col(a) - F.col(b) / F.lit(scale))
    return df.agg(F.max(d).alias("max_abs_diff"), F.avg(d).alias("mean_abs_diff"),
                  F.count_if(d > tol).cast("bigint").alias("n_mismatch"),
                  F.coalesce(F.bool_and(d <= tol), F.lit(True)).alias("all_match"))


def label_quality(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Distinct labels, rows with outer whitespace, case-variant groups, blank labels and
    known misspellings — computed from the per-label counts (one small aggregate)."""
    counts = df.groupBy(F.col(spec.target).alias("l")).agg(F.count(F.lit(1)).alias("c"))
    variants = (counts.where(F.col("l").isNotNull() & (F.trim("l") != ""))
                .groupBy(F.lower(F.trim("l")).alias("k")).agg(F.count_distinct("l").alias("v"))
                .agg(F.count_if(F.col("v") > 1).cast("bigint").alias("n_case_variant_groups")))
    bad = list(spec.label_fixes.keys())
    summary = counts.agg(
        F.count_distinct("l").cast("bigint").alias("n_labels"),
        F.coalesce(F.sum(F.when((F.col("l") != F.trim("l")) & (F.trim("l") != ""), F.col("c"))), F.lit(0)).cast("bigint").alias("n_outer_whitespace_rows"),
        F.coalesce(F.sum(F.when(F.col("l").isNull() | (F.trim("l") == ""), F.col("c"))), F.lit(0)).cast("bigint").alias("n_blank_labels"),
        F.coalesce(F.sum(F.when(F.col("l").isin(bad), F.col("c"))), F.lit(0)).cast("bigint").alias("n_misspelled_rows"))
    parts = summary.select(F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).alias("v"))
                                              for m in ("n_labels", "n_outer_whitespace_rows", "n_blank_labels", "n_misspelled_rows")])))
    parts = parts.unionByName(variants.select(F.lit("n_case_variant_groups").alias("m"), F.col("n_case_variant_groups").alias("v")))
    names = ["n_labels", "n_outer_whitespace_rows", "n_case_variant_groups", "n_blank_labels", "n_misspelled_rows"]
    return (parts.groupBy().pivot("m", names).agg(F.first("v"))
            .select(*[F.col(n).cast("bigint") for n in names])
            .withColumn("has_known_misspelling", F.col("n_misspelled_rows") > 0))
