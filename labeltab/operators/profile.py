"""Aggregation and profiling operators.

Physical shape used throughout: **one wide aggregate** over all features (partial aggregation
on the map side, a tiny final merge), then ``inline`` of an array of per-feature structs, so
the output has one row per feature without a second scan or an unpivot that would multiply
the input by the feature count. Per-class variants add the class to ``groupBy``; a class that
holds a third of all rows is harmless because only partial aggregates are shuffled.

Anything brought back to the driver is an aggregate whose size is bounded by the number of
features or classes (fences, min/max).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.functions.exprs import (
    clean_number,
    feature_structs,
    is_blank,
    is_floating,
    is_missing,
    is_numeric,
    sanitize,
)
from labeltab.functions.quantile import exact_quantiles, quantile_columns
from labeltab.operators.inventory import row_keys
from labeltab.spec import TableSpec


def _dt(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def _labelled(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Rows with a present label (pandas groupby / value_counts drop missing keys)."""
    return df.where(~is_missing(spec.target, _dt(df, spec.target)))


_QNAMES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _attach_quantiles(long: DataFrame, df: DataFrame, groups: Sequence[str],
                      feats: Sequence[str], stats: Sequence[str], rename: dict[str, str],
                      order: Sequence[str]) -> DataFrame:
    """Join exact quantiles (one row per group x feature) onto a long result."""
    qs = [s for s in ("q1", "median", "q3") if s in stats]
    if not qs:
        return long
    qdf = quantile_columns(exact_quantiles(df, groups, feats, [_QNAMES[s] for s in qs]),
                           [*groups, "feature"], {_QNAMES[s]: rename.get(s, s) for s in qs})
    return long.join(qdf, [*groups, "feature"], "left").select(*order)


# ---- A01–A03 class counts ---------------------------------------------------------------

def class_counts(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(label, n) in label order."""
    return (_labelled(df, spec).groupBy(F.col(spec.target).alias("label"))
            .agg(F.count(F.lit(1)).alias("n")).orderBy("label"))


def class_counts_by_frequency(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(label, n, rank, n_classes), most frequent first, ties by label."""
    counts = class_counts(df, spec)
    w = Window.orderBy(F.desc("n"), F.asc("label"))  # over k aggregated rows only
    return (counts.withColumn("rank", F.row_number().over(w))
            .withColumn("n_classes", F.count(F.lit(1)).over(Window.partitionBy()).cast("bigint"))
            .orderBy("rank"))


def class_balance(df: DataFrame, spec: TableSpec) -> DataFrame:
    """Share per class plus largest/smallest class and their ratio."""
    counts = class_counts(df, spec)
    whole = Window.partitionBy()  # k aggregated rows
    big = Window.orderBy(F.desc("n"), F.asc("label"))
    small = Window.orderBy(F.asc("n"), F.asc("label"))
    t = (counts.withColumn("total", F.sum("n").over(whole))
         .withColumn("r_big", F.row_number().over(big))
         .withColumn("r_small", F.row_number().over(small)))
    largest = F.max(F.when(F.col("r_big") == 1, F.struct("n", "label"))).over(whole)
    smallest = F.max(F.when(F.col("r_small") == 1, F.struct("n", "label"))).over(whole)
    return (t.select(
        "label", "n",
        (F.col("n") * 100.0 / F.col("total")).alias("percent"),
        largest["label"].alias("largest_label"), largest["n"].alias("largest_n"),
        smallest["label"].alias("smallest_label"), smallest["n"].alias("smallest_n"),
        (largest["n"] / smallest["n"]).alias("imbalance_ratio"),
    ).orderBy("label"))


# ---- A04–A07 summaries ------------------------------------------------------------------

def _stat_aggs(df: DataFrame, feats: Sequence[str], stats: Sequence[str]):
    """Aggregate expressions, one set per feature, named ``<stat>__<i>`` (quantiles apart)."""
    aggs = []
    for i, f in enumerate(feats):
        dt = _dt(df, f)
        v = clean_number(f, dt)
        for s in stats:
            if s == "n":
                aggs.append(F.count(v).alias(f"n__{i}"))
            elif s == "mean":
                aggs.append(F.avg(v).alias(f"mean__{i}"))
            elif s == "std":
                aggs.append(F.stddev_samp(v).alias(f"std__{i}"))
            elif s == "var":
                aggs.append(F.var_samp(v).alias(f"var__{i}"))
            elif s == "min":
                aggs.append(F.min(v).alias(f"min__{i}"))
            elif s == "max":
                aggs.append(F.max(v).alias(f"max__{i}"))
            elif s == "n_missing":
                aggs.append(F.count_if(is_missing(f, dt)).alias(f"n_missing__{i}"))
            elif s == "n_unique":
                aggs.append(F.count_distinct(v).alias(f"n_unique__{i}"))
    return aggs


def _stat_fields(feats: Sequence[str], stats: Sequence[str], names: dict[str, str] | None = None):
    names = names or {}
    stats = [s for s in stats if s not in _QNAMES]
    out = []
    for i, f in enumerate(feats):
        cols = {}
        for s in stats:
            if s in ("n", "n_missing", "n_unique"):
                cols[names.get(s, s)] = F.col(f"{s}__{i}").cast("bigint")
            else:
                cols[names.get(s, s)] = F.col(f"{s}__{i}").cast("double")
        out.append((f, cols))
    return out


def describe(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles, max and missing per feature (one pass)."""
    feats = list(features or spec.features)
    stats = ["n", "mean", "std", "min", "q1", "median", "q3", "max", "n_missing"]
    names = {"q1": "p25", "median": "p50", "q3": "p75"}
    one = df.agg(*_stat_aggs(df, feats, stats))
    out = one.select(F.inline(feature_structs(_stat_fields(feats, stats, names))))
    order = ["feature", *[names.get(s, s) for s in stats]]
    return _attach_quantiles(out, df, [], feats, stats, names, order)


def feature_summary(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """Min, max, mean, median, std, number of distinct values per feature."""
    feats = list(features or spec.features)
    stats = ["min", "max", "mean", "median", "std", "n_unique"]
    one = df.agg(*_stat_aggs(df, feats, stats))
    out = one.select(F.inline(feature_structs(_stat_fields(feats, stats))))
    return _attach_quantiles(out, df, [], feats, stats, {}, ["feature", *stats])


def class_stats(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None,
                five_number: bool = False) -> DataFrame:
    """A06 (long): mean, median, std, min, max per (class, feature).
    A07 (``five_number=True``): adds n, q1, q3, iqr."""
    feats = list(features or spec.features)
    stats = (["n", "mean", "median", "std", "min", "q1", "q3", "max"] if five_number
             else ["mean", "median", "std", "min", "max"])
    lab = _labelled(df, spec)
    lab = lab.withColumn("label", F.col(spec.target))
    wide = lab.groupBy("label").agg(*_stat_aggs(df, feats, stats))
    out = wide.select("label", F.inline(feature_structs(_stat_fields(feats, stats))))
    out = _attach_quantiles(out, lab, ["label"], feats, stats, {}, ["label", "feature", *stats])
    return out.withColumn("iqr", F.col("q3") - F.col("q1")) if five_number else out


def class_stats_wide(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """A06 (wide): one row per class, columns ``<feature>_<stat>``."""
    feats = list(features or spec.features)
    stats = ["mean", "median", "std", "min", "max"]
    lab = _labelled(df, spec).withColumn("label", F.col(spec.target))
    wide = lab.groupBy("label").agg(*_stat_aggs(df, feats, stats))
    medians = exact_quantiles(lab, ["label"], feats, [0.5]).groupBy("label").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("q"))).alias(f"median__{i}") for i, f in enumerate(feats)])
    return wide.join(medians, "label", "left").select(
        "label", *[F.col(f"{s}__{i}").cast("double").alias(f"{f}_{s}") for i, f in enumerate(feats) for s in stats])


# ---- A08 outliers, A11 histogram, A12 box plots ---------------------------------------

def _fences(df: DataFrame, spec: TableSpec, feats: Sequence[str]) -> list[tuple[float, float]]:
    """(q1, q3) per feature — one aggregate row, bounded by the feature count."""
    got = {(r.feature, r.p): r.q for r in exact_quantiles(df, [], feats, [0.25, 0.75]).collect()}  # f x 2 numbers
    return [(got.get((f, 0.25)), got.get((f, 0.75))) for f in feats]


def iqr_outliers(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """Tukey fences (1.5·IQR), strict comparisons, count and percent of all rows."""
    feats = list(features or spec.features)
    fences = _fences(df, spec, feats)
    aggs, fields = [F.count(F.lit(1)).alias("n_rows")], []
    for i, f in enumerate(feats):
        q1, q3 = fences[i]
        v = clean_number(f, _dt(df, f))
        if q1 is None:
            lo = hi = None
            cnt = F.lit(0)
        else:
            lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
            cnt = F.count_if((v < F.lit(lo)) | (v > F.lit(hi)))
        aggs.append(cnt.alias(f"o{i}"))
        fields.append((f, {"q1": F.lit(q1).cast("double"), "q3": F.lit(q3).cast("double"),
                           "lower_fence": F.lit(lo).cast("double"), "upper_fence": F.lit(hi).cast("double"),
                           "outlier_count": F.col(f"o{i}").cast("bigint"),
                           "outlier_pct": F.try_divide(F.col(f"o{i}") * 100.0, F.col("n_rows"))}))
    return df.agg(*aggs).select(F.inline(feature_structs(fields)))


def histogram(df: DataFrame, spec: TableSpec, feature: str | None = None, bins: int = 30) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; always ``bins`` rows."""
    f = feature or spec.features[0]
    v = clean_number(f, _dt(df, f))
    mm = df.agg(F.min(v).alias("mn"), F.max(v).alias("mx")).first()
    mn, mx = mm["mn"], mm["mx"]
    spark = df.sparkSession
    if mn is None:
        mn, mx = 0.0, 1.0
    if mx == mn:  # numpy widens a degenerate range by 0.5 each side
        mn, mx = mn - 0.5, mx + 0.5
    b = F.least(F.floor((v - F.lit(mn)) / F.lit(mx - mn) * bins), F.lit(bins - 1)).cast("int")
    counts = df.where(v.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    w = (mx - mn) / bins
    return (grid.join(F.broadcast(counts), "bin", "left")  # both sides <= bins rows
            .select("bin", (F.lit(mn) + F.col("bin") * F.lit(w)).alias("lo"),
                    (F.lit(mn) + (F.col("bin") + 1) * F.lit(w)).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))
            .orderBy("bin"))


def box_stats(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """Quartiles, whiskers (extreme points inside 1.5·IQR) and flier counts per class and
    overall (label ``*``). Two scans: a rollup of quartiles, then a rollup of the whisker
    aggregates with each row carrying its class fences (broadcast, k rows) and the overall
    fences (literals)."""
    feats = list(features or spec.features)
    lab = _labelled(df, spec).withColumn("label", F.col(spec.target).cast("string"))
    names = {0.25: "a", 0.5: "b", 0.75: "c"}
    both = quantile_columns(exact_quantiles(lab, ["label"], feats, list(names), overall_label="\u0000*"),
                            ["label", "feature"], names)
    u = both.select(F.when(F.col("label") == "\u0000*", F.lit(None)).otherwise(F.col("label")).alias("label"),
                    (F.col("label") == "\u0000*").cast("int").alias("g"), "feature", "a", "b", "c")
    quart = u.groupBy("label", "g").agg(*[F.max(F.when(F.col("feature") == f, F.array("a", "b", "c"))).alias(f"q{i}")
                                         for i, f in enumerate(feats)])  # (k + 1) x f rows
    first = quart.where("g = 1").first()
    overall = first.asDict() if first else {f"q{i}": None for i in range(len(feats))}
    per_class = quart.where("g = 0")
    fence_cols = []
    for i in range(len(feats)):
        q = F.col(f"q{i}")
        fence_cols += [(q[0] - 1.5 * (q[2] - q[0])).alias(f"lo{i}"), (q[2] + 1.5 * (q[2] - q[0])).alias(f"hi{i}")]
    fences = per_class.select("label", *fence_cols)
    j = lab.join(fences, "label")  # k rows: the optimizer broadcasts it under its threshold
    aggs = [F.grouping("label").alias("g")]
    for i, f in enumerate(feats):
        v = clean_number(f, _dt(df, f))
        oq = overall[f"q{i}"] or [None, None, None]
        olo = oq[0] - 1.5 * (oq[2] - oq[0]) if oq[0] is not None else None
        ohi = oq[2] + 1.5 * (oq[2] - oq[0]) if oq[0] is not None else None
        clo, chi = F.col(f"lo{i}"), F.col(f"hi{i}")
        aggs += [F.min(F.when(v >= clo, v)).alias(f"cwl{i}"), F.max(F.when(v <= chi, v)).alias(f"cwh{i}"),
                 F.count_if((v < clo) | (v > chi)).alias(f"cf{i}"),
                 F.min(F.when(v >= F.lit(olo), v)).alias(f"owl{i}"), F.max(F.when(v <= F.lit(ohi), v)).alias(f"owh{i}"),
                 F.count_if((v < F.lit(olo)) | (v > F.lit(ohi))).alias(f"of{i}")]
    wh = j.rollup("label").agg(*aggs)
    allq = quart.select(F.when(F.col("g") == 1, F.lit("*")).otherwise(F.col("label")).alias("label"),
                        *[F.col(f"q{i}") for i in range(len(feats))])
    whk = wh.select(F.when(F.col("g") == 1, F.lit("*")).otherwise(F.col("label")).alias("label"),
                    *[F.when(F.col("g") == 1, F.col(f"ow{s}{i}")).otherwise(F.col(f"cw{s}{i}")).alias(f"w{s}{i}")
                      for i in range(len(feats)) for s in ("l", "h")],
                    *[F.when(F.col("g") == 1, F.col(f"of{i}")).otherwise(F.col(f"cf{i}")).alias(f"nf{i}")
                      for i in range(len(feats))])
    fields = [(f, {"q1": F.col(f"q{i}")[0], "median": F.col(f"q{i}")[1], "q3": F.col(f"q{i}")[2],
                   "whisker_lo": F.col(f"wl{i}").cast("double"), "whisker_hi": F.col(f"wh{i}").cast("double"),
                   "n_fliers": F.col(f"nf{i}").cast("bigint")}) for i, f in enumerate(feats)]
    return (allq.join(whk, "label")  # both sides k+1 rows
            .select("label", F.inline(feature_structs(fields))))


# ---- A09–A10 correlation ----------------------------------------------------------------

def correlation(df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation on pairwise-complete rows, full square, one aggregate."""
    feats = list(features or spec.features)
    vals = {f: clean_number(f, _dt(df, f)) for f in feats}
    aggs = []
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            if j >= i:
                aggs.append(F.corr(vals[a], vals[b]).alias(f"c{i}_{j}"))
    one = df.agg(*aggs)
    rows = []
    for i, a in enumerate(feats):
        for j, b in enumerate(feats):
            src = f"c{min(i, j)}_{max(i, j)}"
            rows.append(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                                 F.lit(i).alias("i"), F.lit(j).alias("j"),
                                 F.col(src).cast("double").alias("correlation")))
    return one.select(F.inline(F.array(*rows)))


def strong_pairs(df: DataFrame, spec: TableSpec, threshold: float = 0.7,
                 features: Sequence[str] | None = None) -> DataFrame:
    """A10: pairs i<j with |r| >= threshold, strongest first."""
    c = correlation(df, spec, features)
    return (c.where((F.col("i") < F.col("j")) & (F.abs("correlation") >= threshold))
            .orderBy(F.desc(F.abs("correlation")), "i", "j")
            .select("feature_a", "feature_b", "correlation"))


# ---- A13 crosstab -----------------------------------------------------------------------

def crosstab(df: DataFrame, category: str, spec: TableSpec) -> DataFrame:
    """Counts and row shares per category x class. Pivot values come from the spec's
    class domain, so no discovery job runs."""
    classes = list(spec.expected_classes) if spec.expected_classes else \
        [r[0] for r in _labelled(df, spec).select(spec.target).distinct().orderBy(spec.target).collect()]  # output columns
    base = df.where(F.col(category).isNotNull()).where(~is_missing(spec.target, _dt(df, spec.target)))
    known = F.col(spec.target).isin(classes)
    rest = "other"  # labels outside the domain are counted, too, under a name that no class has
    while rest in {sanitize(str(c)) for c in classes} | {str(c) for c in classes}:
        rest += "_labels"
    names = [*[str(c) for c in classes], rest]
    base = base.withColumn("__class", F.when(known, F.col(spec.target).cast("string")).otherwise(F.lit(rest)))
    pv = base.groupBy(F.col(category).alias("category")).pivot("__class", names).count().na.fill(0)
    total = sum((F.col(f"`{c}`") for c in names), F.lit(0))
    return pv.select(
        "category",
        *[F.col(f"`{c}`").cast("bigint").alias(f"n_{sanitize(c)}") for c in names],
        *[F.try_divide(F.col(f"`{c}`"), total).alias(f"share_{sanitize(c)}") for c in names],
    ).orderBy("category")


# ---- A15 column classification (A14: operators/inventory.py) -------------------------------

def classify_columns(inventory: DataFrame, rules: DataFrame) -> DataFrame:
    """Attach curated (group, leakage class, reason) rules to the inventory; ``usable``
    = a SAFE leakage class on a non-constant numeric column. ``rules`` is a small dimension
    (one row per column) and is broadcast."""
    return (inventory.join(F.broadcast(rules), "column_name", "left")
            .select("column_name", "data_type", "feature_type",
                    F.coalesce("feature_group", F.lit("Unclassified")).alias("feature_group"),
                    F.coalesce("leakage_classification", F.lit("UNKNOWN")).alias("leakage_classification"),
                    F.coalesce("leakage_reason", F.lit("No rule for this column.")).alias("leakage_reason"),
                    (F.coalesce(F.col("leakage_classification").startswith("SAFE"), F.lit(False))
                     & (F.col("feature_type") == "numeric") & ~F.col("constant_column")).alias("usable")))


# ---- A16–A19 determinism, leakage, dataset comparison -------------------------------------

def value_determinism(df: DataFrame, spec: TableSpec, feature: str | None = None) -> DataFrame:
    """How many classes each feature value maps to."""
    f = feature or spec.features[0]
    per_value = (_labelled(df, spec).where(~is_missing(f, _dt(df, f)))
                 .groupBy(f).agg(F.count_distinct(spec.target).alias("k")))
    return per_value.agg(F.count(F.lit(1)).alias("n_values"),
                         F.count_if(F.col("k") == 1).alias("n_single_class"),
                         F.count_if(F.col("k") > 1).alias("n_multi_class"),
                         F.max("k").cast("bigint").alias("max_classes"))


def duplicate_rows(df: DataFrame, columns: Sequence[str]) -> F.Column:
    """Rows beyond the first occurrence over ``columns`` (null and NaN group as equal)."""
    return df.groupBy(*columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("bigint").alias("n"))


def leakage_overlap(split_df: DataFrame, spec: TableSpec, features: Sequence[str] | None = None,
                    split_col: str = "split") -> DataFrame:
    """Distinct feature rows / feature+label rows present in both splits, and duplicate
    rows inside the test split (set semantics, as ``intersect``). One partially-aggregated
    ``groupBy(features, label, split)`` over the split table; every count is then a
    second-level aggregate of that distinct-row table — no intersect, no second scan."""
    feats = list(features or spec.features)
    rows = feats + [spec.target]
    g = split_df.groupBy(*rows, split_col).agg(F.count(F.lit(1)).alias("c"))
    is_test = F.col(split_col) == "test"
    by_row = g.groupBy(*rows).agg(F.max(F.when(~is_test, 1).otherwise(0)).alias("tr"),
                                  F.max(F.when(is_test, 1).otherwise(0)).alias("te"),
                                  F.sum(F.when(is_test, F.col("c")).otherwise(0)).alias("c_te"))
    by_feat = by_row.groupBy(*feats).agg(F.max("tr").alias("tr"), F.max("te").alias("te"), F.sum("c_te").alias("c_te"))
    r = by_row.agg(F.sum("c_te").alias("n_test"), F.sum(F.greatest(F.col("c_te") - 1, F.lit(0))).alias("dup_test_rows"),
                   F.count_if((F.col("tr") == 1) & (F.col("te") == 1)).alias("row_overlap"))
    f = by_feat.agg(F.sum(F.greatest(F.col("c_te") - 1, F.lit(0))).alias("dup_test_features"),
                    F.count_if((F.col("tr") == 1) & (F.col("te") == 1)).alias("feature_overlap"))
    names = ["n_test", "dup_test_features", "dup_test_rows", "feature_overlap", "row_overlap"]
    u = (r.select(F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("bigint").alias("v"))
                                     for m in ("n_test", "dup_test_rows", "row_overlap")])))
         .unionByName(f.select(F.inline(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("bigint").alias("v"))
                                                  for m in ("dup_test_features", "feature_overlap")])))))
    # two one-row aggregates -> one row, without a join
    return u.groupBy().pivot("m", names).agg(F.first("v")).select(
        *[F.coalesce(F.col(n), F.lit(0)).cast("bigint").alias(n) for n in names])


def dataset_profile(df: DataFrame, spec: TableSpec, name: str) -> DataFrame:
    """One row of Q05-style metrics tagged with the dataset name (input of A19). One group-by on row
    digests (``row_keys``) yields the duplicates and carries the missing cells and the label along, so a distinct row
    ships its digest, two counts and its label, not its columns."""
    cols = spec.columns
    dt = {c: _dt(df, c) for c in cols}
    miss = sum((is_missing(c, dt[c]).cast("long") for c in cols), F.lit(0))
    label = F.when(~is_missing(spec.target, dt[spec.target]), F.col(spec.target))
    keys = [*row_keys(df, df.columns), label.alias("__label")]  # the label as a key: a text among the sums would need a sort
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(miss).alias("__miss"))
    return groups.agg(
        F.lit(name).alias("dataset"),
        F.sum("__n").cast("bigint").alias("n_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("n_columns"),
        F.sum(F.col("__n") - 1).cast("bigint").alias("n_duplicates"),
        F.sum("__miss").cast("bigint").alias("n_missing"),
        F.count_distinct("__label").cast("bigint").alias("n_classes"))


def compare_datasets(profiles: dict[str, DataFrame]) -> DataFrame:
    """Side-by-side metrics; one row per metric, one column per dataset (name -> the
    one-row ``dataset_profile``). Pivot values are the given names, so nothing runs twice."""
    frames = list(profiles.values())
    u = frames[0]
    for p in frames[1:]:
        u = u.unionByName(p)
    metrics = ["n_rows", "n_columns", "n_duplicates", "n_missing", "n_classes"]
    long = u.select("dataset", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                  for m in metrics])))
    return long.groupBy("metric").pivot("dataset", list(profiles)).agg(F.first("value")).orderBy("metric")


def rank_features(relevance: DataFrame, score: str = "f_stat") -> DataFrame:
    """Features ordered by a relevance score (descending), with their rank."""
    w = Window.orderBy(F.desc_nulls_last(score), "feature")  # one row per feature
    return relevance.select("feature", score).withColumn("rank", F.row_number().over(w)).orderBy("rank")
