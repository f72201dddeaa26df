"""Registered queries: each binds an operator to the driver tables.

Every query takes ``(spark, sf_dir)``, reads the whole source tables (or data Spark derives
from them) and returns a DataFrame whose double columns are rounded to 6 decimals so the
independent SQL oracle in ``labeltab.plans.oracle`` can compare values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.functions.exprs import r6, strict_number
from labeltab.operators import inventory as INV
from labeltab.operators import profile as A
from labeltab.operators import relevance as R
from labeltab.operators.gram import wide_correlation
from labeltab.operators.neighbour_mi import neighbour_information
from labeltab.plans import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (top level) so both engines hash the same values."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(r6(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def li(spark, sf):
    return X.lineitem_labelled(spark, sf)


# ---- flagship: which feature separates the classes, and by how much --------------------

def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem -> projection -> per-class moments -> ANOVA F, eta^2 and mean range."""
    df = li(spark, sf_dir).select(*X.LI_SPEC.columns)
    return finish(R.anova(df, X.LI_SPEC).orderBy(F.desc("f_stat")))


# ---- A: profiling ------------------------------------------------------------------------

@register("a01_class_counts")
def a01(spark, sf):
    return A.class_counts(li(spark, sf), X.LI_SPEC)


@register("a02_class_frequency")
def a02(spark, sf):
    return A.class_counts_by_frequency(X.load(spark, sf, "orders"), X.OD_SPEC)


@register("a03_class_balance")
def a03(spark, sf):
    return finish(A.class_balance(X.load(spark, sf, "events"), X.EV_SPEC))


@register("a04_describe")
def a04(spark, sf):
    return finish(A.describe(li(spark, sf), X.LI_SPEC))


@register("a05_feature_summary")
def a05(spark, sf):
    return finish(A.feature_summary(X.load(spark, sf, "part"), X.PT_SPEC))


@register("a06_class_stats")
def a06(spark, sf):
    return finish(A.class_stats(li(spark, sf), X.LI_SPEC))


@register("a06_class_stats_wide")
def a06w(spark, sf):
    return finish(A.class_stats_wide(li(spark, sf), X.LI_SPEC))


@register("a07_class_summary")
def a07(spark, sf):
    return finish(A.class_stats(li(spark, sf), X.LI_SPEC, five_number=True))


@register("a08_iqr_outliers")
def a08(spark, sf):
    ev = X.load(spark, sf, "events")
    return finish(A.iqr_outliers(ev, X.EV_SPEC))


@register("a08_iqr_outliers_lineitem")
def a08li(spark, sf):
    return finish(A.iqr_outliers(li(spark, sf), X.LI_SPEC))


@register("a09_correlation")
def a09(spark, sf):
    return finish(A.correlation(li(spark, sf), X.LI_SPEC).drop("i", "j"))


@register("a09_correlation_wide")
def a09w(spark, sf):
    return finish(wide_correlation(li(spark, sf), X.LI_FEATURES).drop("i", "j"))


@register("a10_strong_pairs")
def a10(spark, sf):
    pt = X.load(spark, sf, "part")
    return finish(A.strong_pairs(pt, X.PT_SPEC, 0.3, ["p_partkey", "p_size", "p_retailprice"]))


@register("a11_histogram")
def a11(spark, sf):
    return finish(A.histogram(X.load(spark, sf, "events"), X.EV_SPEC, "value", 30))


@register("a12_box_stats")
def a12(spark, sf):
    return finish(A.box_stats(li(spark, sf), X.LI_SPEC))


@register("a13_crosstab")
def a13(spark, sf):
    return finish(A.crosstab(X.load(spark, sf, "orders"), "o_orderstatus", X.OD_SPEC))


@register("a14_column_inventory")
def a14(spark, sf):
    return finish(INV.column_inventory(X.load(spark, sf, "part")))


@register("a14_column_inventory_text")
def a14_text(spark, sf):
    return finish(INV.column_inventory(X.d1(spark, sf), parsed=["f1"]))


# Curated rules for the lineitem columns (group, leakage class, reason).
LI_COLUMN_RULES = [
    ("l_orderkey", "Identifier", "EXCLUDE_ID", "Order identifier; carries no measurement."),
    ("l_partkey", "Identifier", "EXCLUDE_ID", "Part identifier; carries no measurement."),
    ("l_suppkey", "Identifier", "EXCLUDE_ID", "Supplier identifier; carries no measurement."),
    ("l_linenumber", "Identifier", "EXCLUDE_ID", "Line position inside an order."),
    ("l_quantity", "Line measures", "SAFE_PRE_LABEL", "Known when the line is entered."),
    ("l_extendedprice", "Line measures", "SAFE_PRE_LABEL", "Known when the line is entered."),
    ("l_discount", "Line measures", "SAFE_PRE_LABEL", "Known when the line is entered."),
    ("l_tax", "Line measures", "SAFE_PRE_LABEL", "Known when the line is entered."),
    ("l_returnflag", "Target", "LEAKAGE", "Target label column."),
    ("l_linestatus", "Status", "LEAKAGE", "Set after the outcome is known."),
    ("l_shipdate", "Dates", "UNKNOWN", "Date column; timing relative to the label is unknown."),
]


@register("a15_column_classification")
def a15(spark, sf):
    inv = INV.column_inventory(X.load(spark, sf, "lineitem"))
    rules = spark.createDataFrame(LI_COLUMN_RULES, "column_name string, feature_group string, "
                                                   "leakage_classification string, leakage_reason string")
    return A.classify_columns(inv, rules)


@register("a16_value_determinism")
def a16(spark, sf):
    return A.value_determinism(X.d2(spark, sf), X.D2_SPEC, "l_quantity")


@register("a19_dataset_compare")
def a19(spark, sf):
    od = X.load(spark, sf, "orders")
    pt = X.load(spark, sf, "part")
    return A.compare_datasets({"orders": A.dataset_profile(od, X.OD_SPEC, "orders"),
                               "part": A.dataset_profile(pt, X.PT_SPEC, "part")})


@register("a20_feature_rank")
def a20(spark, sf):
    return finish(A.rank_features(R.anova(X.d2(spark, sf), X.D2_SPEC), "f_stat"))


# ---- R: relevance ------------------------------------------------------------------------

@register("r01_anova")
def r01(spark, sf):
    return finish(R.anova(li(spark, sf), X.LI_SPEC))


@register("r01_anova_separable")
def r01s(spark, sf):
    return finish(R.anova(X.d2(spark, sf), X.D2_SPEC))


@register("r02_anova_pvalue")
def r02(spark, sf):
    return finish(R.anova_pvalue(R.anova(li(spark, sf), X.LI_SPEC)))


@register("r05_mutual_information")
def r05(spark, sf):
    return finish(R.mutual_information(X.d2(spark, sf), X.D2_SPEC, bins=20))


@register("r05_neighbour_information")
def r05n(spark, sf):
    """The nearest-neighbour estimate on lineitem, with the x100 copy of a feature that the recorded table has."""
    d = li(spark, sf).withColumn("quantity_copy", F.col("l_quantity") / 100)
    spec = X.LI_SPEC.with_(features=(*X.LI_FEATURES, "quantity_copy"))
    return finish(neighbour_information(d, spec))


@register("r05_neighbour_information_separable")
def r05ns(spark, sf):
    return finish(neighbour_information(X.d2(spark, sf), X.D2_SPEC))


@register("r06_categorical_relevance")
def r06(spark, sf):
    return finish(R.categorical_relevance(X.load(spark, sf, "orders"), X.OD_SPEC, ["o_orderstatus"]))


@register("r06_chi2_pvalue")
def r06p(spark, sf):
    return finish(R.chi_square_pvalue(R.categorical_relevance(X.load(spark, sf, "orders"), X.OD_SPEC, ["o_orderstatus"])))


@register("r10_class_ranges")
def r10(spark, sf):
    return finish(R.class_ranges(X.d2(spark, sf), X.D2_SPEC))


@register("r12_range_overlaps")
def r12(spark, sf):
    return finish(R.range_overlaps(X.load(spark, sf, "events"), X.EV_SPEC))


@register("r13_granularity")
def r13(spark, sf):
    return finish(R.granularity(li(spark, sf), X.LI_SPEC))


@register("r14_scaled_copy")
def r14(spark, sf):
    d = li(spark, sf)
    # a x100 copy of l_quantity, off by one where the row digest starts with "00"
    copy = F.col("l_quantity") * 100 + F.when(F.substring(F.md5("rid"), 1, 2) == "00", F.lit(1.0)).otherwise(F.lit(0.0))
    return finish(R.scaled_copy_check(d.withColumn("q100", copy), "l_quantity", "q100", 100.0))


@register("r15_label_quality")
def r15(spark, sf):
    return R.label_quality(X.d1(spark, sf), X.D1_SPEC)


# ---- Q: contract and data quality ---------------------------------------------------------

from labeltab.operators import clean as C  # noqa: E402
from labeltab.operators import contract as Q  # noqa: E402
from labeltab.operators import split as S  # noqa: E402

PART_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LINEITEM_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
                    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LI_FLAG = X.LI_SPEC.with_(expected_classes=None)  # classes discovered from the data


@register("q01_schema_contract")
def q01(spark, sf):
    return Q.schema_contract(X.load(spark, sf, "part"), PART_COLUMNS)


@register("q02_required_columns")
def q02(spark, sf):
    return Q.required_columns(X.load(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice", "p_brand", "p_color"])


@register("q03_non_empty")
def q03(spark, sf):
    return Q.non_empty({t: X.load(spark, sf, t) for t in X.TABLES})


@register("q04_type_kinds")
def q04(spark, sf):
    return Q.type_kinds(X.load(spark, sf, "part"), X.PT_SPEC)


@register("q05_table_profile")
def q05(spark, sf):
    return Q.table_profile(X.load(spark, sf, "lineitem"), X.LI_SPEC, "lineitem")


@register("q06_missing_counts")
def q06(spark, sf):
    return Q.missing_counts(X.d1(spark, sf))


@register("q09_numeric_validity")
def q09(spark, sf):
    return Q.numeric_validity(X.d1(spark, sf), ["f1"])


@register("q09_numeric_report")
def q09r(spark, sf):
    """The text column of D1 and a numeric column with missing and infinite values made from it."""
    d = X.d1(spark, sf).withColumn("f2", strict_number(F.col("f1")))
    return Q.numeric_report(d, ["f1", "f2"])


@register("q10_finite_gate")
def q10(spark, sf):
    return Q.finite_gate(X.load(spark, sf, "lineitem"), list(X.LI_FEATURES))


@register("q11_bounds_rules")
def q11(spark, sf):
    return Q.bounds_rule_counts(X.d1(spark, sf), X.D1_SPEC)


@register("q12_duplicate_count")
def q12(spark, sf):
    return Q.duplicate_count(X.load(spark, sf, "part"), ["p_size", "p_type", "p_brand"])


@register("q13_duplicate_positions")
def q13p(spark, sf):
    return Q.duplicate_positions(spark, X.table_path(sf, "part"), ["p_size", "p_type", "p_brand"])


@register("q13_duplicate_listing")
def q13(spark, sf):
    return Q.duplicate_listing(X.load(spark, sf, "part"), ["p_size", "p_type", "p_brand"], "p_partkey")


@register("q14_checklist")
def q14(spark, sf):
    return Q.checklist(X.load(spark, sf, "lineitem"), X.LI_SPEC, LINEITEM_COLUMNS)


def li_split(spark, sf):
    return S.stratified_split(li(spark, sf), X.LI_SPEC)


@register("q15_split_shape")
def q15(spark, sf):
    return Q.split_shape(li_split(spark, sf), X.LI_SPEC.test_fraction)


@register("q16_class_domain")
def q16(spark, sf):
    return Q.class_domain(X.load(spark, sf, "lineitem"), X.LI_SPEC)


@register("q17_encoded_range")
def q17(spark, sf):
    sp = li_split(spark, sf)
    dim = S.label_dimension(sp, LI_FLAG)
    return Q.encoded_range(S.encode(sp, X.LI_SPEC, dim))


@register("q18_row_validation")
def q18(spark, sf):
    return Q.validation_report(X.d1(spark, sf), X.D1_SPEC)


# ---- C: cleaning, encoding, split ------------------------------------------------------------

@register("c01_projection")
def c01(spark, sf):
    return C.project(X.load(spark, sf, "lineitem"), X.LI_SPEC)


@register("c02_blank_drop")
def c02(spark, sf):
    return C.drop_blank_and_missing(X.d1(spark, sf), ["f1", "label"])


@register("c03_drop_incomplete")
def c03(spark, sf):
    return C.drop_incomplete_report(X.d1(spark, sf), ["f1", "label"])


@register("c04_drop_duplicates")
def c04(spark, sf):
    return C.drop_duplicates(X.load(spark, sf, "part").select("p_size", "p_type", "p_brand"))


@register("c05_bounds_drop")
def c05(spark, sf):
    return C.drop_out_of_bounds(X.d1(spark, sf), X.D1_SPEC)


@register("c06_label_fix")
def c06(spark, sf):
    return C.label_fix_report(X.d1(spark, sf), X.D1_SPEC)


@register("c07_lineage")
def c07(spark, sf):
    return C.lineage(X.d1(spark, sf), X.D1_SPEC)


@register("c07_lineage_labels")
def c07l(spark, sf):
    return C.lineage_with_labels(X.d1(spark, sf), X.D1_SPEC)


@register("c08_label_encode")
def c08(spark, sf):
    return S.label_dimension(X.load(spark, sf, "lineitem"), LI_FLAG)


@register("c08_label_encode_integer")
def c08i(spark, sf):
    return S.label_dimension(X.load(spark, sf, "part"), X.PT_SPEC.with_(target="p_size"))


@register("c09_label_decode")
def c09(spark, sf):
    d = X.load(spark, sf, "lineitem")
    dim = S.label_dimension(d, LI_FLAG)
    dec = S.decode(S.encode(d, X.LI_SPEC, dim), dim)
    return dec.groupBy(F.col("l_returnflag").alias("label"), "code", "decoded").agg(F.count(F.lit(1)).alias("n"))


@register("c10_split")
def c10(spark, sf):
    return li_split(spark, sf).select("rid", F.col("l_returnflag").alias("label"), "split")


@register("c11_split_report")
def c11(spark, sf):
    return S.split_report(li_split(spark, sf), X.LI_SPEC)


def li_folds(spark, sf):
    return S.stratified_folds(li_split(spark, sf).where("split = 'train'"), X.LI_SPEC)


@register("c12_folds")
def c12(spark, sf):
    return li_folds(spark, sf).select("rid", F.col("l_returnflag").alias("label"), "fold")


@register("c13_fold_sizes")
def c13(spark, sf):
    return S.fold_sizes(li_folds(spark, sf))


@register("c14_union")
def c14(spark, sf):
    sp = li_split(spark, sf)
    u = S.union_splits([sp.where("split = 'train'"), sp.where("split = 'test'")])
    return u.groupBy(F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("c15_ablation_sets")
def c15(spark, sf):
    return S.ablation_sets(X.d2(spark, sf), X.D2_SPEC)


@register("c16_derived_columns")
def c16(spark, sf):
    return finish(C.derived_columns(li(spark, sf)).select(
        "rid", "discount_pct", "flag_equals_status", "abs_net_change", "tax_to_net_ratio"))


@register("a17_leakage_overlap")
def a17(spark, sf):
    spec = X.LI_SPEC.with_(features=("l_quantity", "l_discount"))
    return A.leakage_overlap(li_split(spark, sf), spec)


@register("a18_union_duplicates")
def a18(spark, sf):
    sp = li_split(spark, sf)
    u = S.union_splits([sp.where("split = 'train'"), sp.where("split = 'test'")])
    return Q.duplicate_count(u, ["l_quantity", "l_discount", "l_returnflag"])


# ---- M: evaluation on deterministic rule predictions (D3) --------------------------------

from labeltab.operators import metrics as M  # noqa: E402
from labeltab.operators import score as SC  # noqa: E402


def d3_conf(spark, sf):
    return M.confusion(X.d3(spark, sf), X.D2_CLASSES)


@register("m06_confusion")
def m06(spark, sf):
    return d3_conf(spark, sf)


@register("m07_summary_metrics")
def m07(spark, sf):
    return finish(M.summary(d3_conf(spark, sf)))


@register("m07_summary_unknown_labels")
def m07u(spark, sf):
    """D3 with labels and predictions outside the class domain, by the row digest."""
    h = F.substring(F.md5("rid"), 1, 2)
    pred = (X.d3(spark, sf).withColumn("label", F.when(h == "00", F.lit(9)).otherwise(F.col("label")))
            .withColumn("prediction", F.when(h.isin("00", "01"), F.lit(7)).otherwise(F.col("prediction"))))
    return finish(M.summary(M.confusion(pred, X.D2_CLASSES), classes=X.D2_CLASSES))


@register("m10_classification_report")
def m10(spark, sf):
    return finish(M.classification_report(d3_conf(spark, sf)))


@register("m11_per_class")
def m11(spark, sf):
    pc = M.per_class(d3_conf(spark, sf))
    return finish(pc.select("model", "class", "precision", "recall", "f1", "support"))


@register("m12_largest_confusions")
def m12(spark, sf):
    return M.largest_confusions(d3_conf(spark, sf)).select("model", "label", "prediction", "n",
                                                          F.col("rank").cast("int"))


@register("m13_model_comparison")
def m13(spark, sf):
    return finish(M.compare_models(M.summary(d3_conf(spark, sf))).withColumn("rank", F.col("rank").cast("int")))


@register("m14_best_model")
def m14(spark, sf):
    return finish(M.select_best(M.summary(d3_conf(spark, sf))))


@register("m15_best_model_v1")
def m15(spark, sf):
    return finish(M.select_best_v1(M.summary(d3_conf(spark, sf))))


@register("m17_easiest_hardest")
def m17(spark, sf):
    return finish(M.easiest_hardest(d3_conf(spark, sf)).withColumn("rank", F.col("rank").cast("int")))


def d2_split(spark, sf):
    return S.stratified_split(X.d2(spark, sf), X.D2_SPEC)


@register("m18_heldout_sample")
def m18(spark, sf):
    test = d2_split(spark, sf).where("split = 'test'")
    pred = X.rule_predictions(test).where("model = 'm_exact'")
    return M.heldout_sample(pred, "rid").withColumn("row_number", F.col("row_number").cast("int"))


def d2_fold_metrics(spark, sf):
    train = d2_written(spark, sf, "train").drop("split")
    pred = X.rule_predictions(S.stratified_folds(train, X.D2_SPEC), keep=("fold",))
    return M.summary(M.confusion(pred, X.D2_CLASSES, ("model", "fold")), ("model", "fold"))


@register("m20_cv_summary")
def m20(spark, sf):
    return finish(M.cv_summary(d2_fold_metrics(spark, sf)))


def named_values(df, values: dict):
    """(m, v) rows of one pass over ``df``."""
    return df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("m"), c.alias("v")) for n, c in values.items()])))


def stability_inputs(spark, sf):
    """One row of evidence for M22, assembled from aggregates without a join."""
    test_pred = X.rule_predictions(d2_test(spark, sf))
    conf = M.confusion(test_pred, X.D2_CLASSES)
    summ = M.summary(conf)
    cv = M.cv_summary(d2_fold_metrics(spark, sf)).where("model = 'm_exact' AND metric = 'macro_f1'")
    anova = R.anova(X.d2(spark, sf), X.D2_SPEC)
    pc = M.per_class(conf).where("model = 'm_exact'")
    parts = [
        named_values(cv, {"cv_macro_f1_mean": F.col("mean"), "cv_macro_f1_std": F.col("std")}),
        summ.where("model IN ('m_exact', 'm_const')").select(
            F.when(F.col("model") == "m_exact", "full_feature_macro_f1").otherwise("no_key_feature_macro_f1").alias("m"), F.col("macro_f1").alias("v")),
        anova.agg((F.sum(F.when(F.col("feature") == "l_quantity", F.col("f_stat"))) / F.sum("f_stat")).alias("v"))
             .select(F.lit("key_feature_normalized_importance").alias("m"), "v"),
        pc.agg(F.min("f1").alias("v")).select(F.lit("minimum_class_f1").alias("m"), "v"),
    ]
    u = parts[0]
    for p_ in parts[1:]:
        u = u.unionByName(p_)
    names = ["cv_macro_f1_mean", "cv_macro_f1_std", "full_feature_macro_f1", "no_key_feature_macro_f1",
             "key_feature_normalized_importance", "minimum_class_f1"]
    return u.groupBy().pivot("m", names).agg(F.first("v"))


@register("m22_stability_verdict")
def m22(spark, sf):
    return finish(M.stability_verdict(stability_inputs(spark, sf), "l_quantity"))


@register("m23_confidence")
def m23(spark, sf):
    return finish(SC.confidence(X.rule_probabilities(X.d2(spark, sf)), "probability", "row_id"))


@register("m24_probability_table")
def m24(spark, sf):
    return finish(SC.probability_table(X.rule_probabilities(X.d2(spark, sf)), X.D2_CLASSES, "probability", "row_id"))


@register("m28_contribution_ranking")
def m28(spark, sf):
    return finish(SC.rank_contributions(X.linear_contributions(X.d2(spark, sf)), list(X.LINEAR_WEIGHTS),
                                        "row_id", "contributions"))


# ---- M: Spark ML fits on the separable table D2 (rows-only checks + invariants) ----------

from labeltab.operators import explain as EX  # noqa: E402
from labeltab.operators import models as ML  # noqa: E402
from labeltab.session import scratch_path  # noqa: E402
from labeltab.sources import io as IO  # noqa: E402
from labeltab.streaming import scoring as ST  # noqa: E402

_WRITTEN: dict = {}


def source_state(spark, sf) -> tuple:
    """Application, folder, and a digest of the names, sizes and times of the files of ``lineitem``."""
    path = X.table_path(sf, "lineitem")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).drop("content")
    got = files.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(20,0)")).alias("d")).first()
    return spark.sparkContext.applicationId, sf, got.n, got.d


def d2_written(spark, sf, part: str):
    """Rows of one part of the D2 split. The split is written once for each state of the source, by part."""
    key = source_state(spark, sf)
    if key not in _WRITTEN:
        path = scratch_path(spark, "d2-split")
        IO.write_by(d2_split(spark, sf), "split", ("train", "test"), path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key]).where(F.col("split") == part)


_FITTED: dict = {}


def fitted_all(spark, sf, names) -> dict:
    """The presets fitted on the training rows; once for each state of the source."""
    state, registry = source_state(spark, sf), ML.PRESETS | ML.SPARK_PRESETS
    missing = {n: registry[n] for n in names if (*state, n) not in _FITTED}
    if missing:
        for n, m in ML.fit_all(d2_written(spark, sf, "train"), X.D2_SPEC, missing).items():
            _FITTED[(*state, n)] = m
    return {n: _FITTED[(*state, n)] for n in names}


def fitted(spark, sf, preset: str):
    return fitted_all(spark, sf, [preset])[preset]


def d2_test(spark, sf):
    return d2_written(spark, sf, "test")


@register("m01_random_forest")
def m01(spark, sf):
    return ML.predict(fitted(spark, sf, "Random Forest"), d2_test(spark, sf), X.D2_SPEC, "Random Forest") \
        .drop("probability")


@register("m02_boosted_presets")
def m02(spark, sf):
    models = fitted_all(spark, sf, ["LightGBM-like", "XGBoost-like", "CatBoost-like"])
    return ML.predict_all(models, d2_test(spark, sf), X.D2_SPEC).drop("probability")


@register("m13_model_comparison_fitted")
def m13f(spark, sf):
    """All four presets evaluated in one job from one confusion table."""
    test = d2_test(spark, sf)
    preds = ML.predict_all(fitted_all(spark, sf, ML.PRESETS), test, X.D2_SPEC)
    return finish(M.compare_models(M.summary(M.confusion(preds, X.D2_CLASSES))))


def saved_models(spark, sf) -> list:
    """All presets, fitted and saved: (model, path, number of trees)."""
    return ML.save_models(fitted_all(spark, sf, ML.PRESETS), scratch_path(spark, "models"), X.D2_SPEC)


@register("m03_train_persist")
def m03(spark, sf):
    """Every saved model is loaded again and scores the test rows: rows and correct rows per model."""
    test, out = d2_test(spark, sf), None
    for name, path, n_trees in saved_models(spark, sf):
        p = (ML.predict(ML.load_checked(path, X.D2_SPEC, ML.PRESETS[name]), test, X.D2_SPEC, name)
             .groupBy("model").agg(F.lit(n_trees).alias("n_trees"), F.count(F.lit(1)).alias("n_rows"),
                                   F.sum((F.col("label") == F.col("prediction")).cast("long")).alias("n_correct")))
        out = p if out is None else out.unionByName(p)
    return out


@register("m03_best_model_apart")
def m03b(spark, sf):
    """The selected model, saved in a folder of its own, loaded from it and held against the fitted one on every test row."""
    models, test = fitted_all(spark, sf, ML.PRESETS), d2_test(spark, sf)
    best = M.select_best(M.summary(M.confusion(ML.predict_all(models, test, X.D2_SPEC), X.D2_CLASSES))).first()[0]
    path = ML.save_best(models, best, scratch_path(spark, "best"), X.D2_SPEC)
    both = (ML.predict(models[best], test, X.D2_SPEC, "fitted")
            .unionByName(ML.predict(ML.load_checked(path, X.D2_SPEC, ML.PRESETS[best]), test, X.D2_SPEC, "loaded")))
    pairs = both.groupBy("rid").agg(F.count(F.lit(1)).alias("n"), F.min("prediction").alias("a"), F.max("prediction").alias("b"),
                                    F.max(F.element_at("probability", 1)).alias("x"), F.min(F.element_at("probability", 1)).alias("y"))
    same = (F.col("n") == 2) & (F.col("a") == F.col("b")) & (F.col("x") == F.col("y"))
    return pairs.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(same.cast("long")).alias("n_same"))


@register("m04_artifact_contract")
def m04(spark, sf):
    """The gate on every saved model against four contracts: its own, another feature order, another encoder, another
    kind. One row a model and contract: whether the gate let it pass, and the rows it scored (0 where it raised)."""
    flipped = X.D2_SPEC.with_(features=tuple(reversed(X.D2_FEATURES)))
    other = X.D2_SPEC.with_(expected_classes=(0, 1, 2, 3, 5))
    out = None
    for name, path, _ in saved_models(spark, sf):
        kind = "boosting" if ML.PRESETS[name].kind == "forest" else "forest"
        wrong = next(p for p in ML.PRESETS.values() if p.kind == kind)
        for contract, spec, preset in (("own", X.D2_SPEC, ML.PRESETS[name]), ("feature_order", flipped, ML.PRESETS[name]),
                                       ("encoder", other, ML.PRESETS[name]), ("kind", X.D2_SPEC, wrong)):
            rows = d2_test(spark, sf)
            try:
                scored = ML.predict(ML.load_checked(path, spec, preset), rows, spec, name)
            except (TypeError, ValueError):
                scored = None
            passed, n = F.lit(scored is not None), F.count(F.lit(1)) if scored is not None else F.lit(0).cast("long")
            row = (rows if scored is None else scored).agg(n.alias("n_scored")).select(
                F.lit(name).alias("model"), F.lit(contract).alias("contract"), passed.alias("passed"), "n_scored")
            out = row if out is None else out.unionByName(row)
    return out


@register("m05_batch_predict")
def m05(spark, sf):
    dim = spark.createDataFrame([(f"class_{c}", c) for c in X.D2_CLASSES], "label string, code int")
    p = ML.predict(fitted(spark, sf, "Random Forest"), d2_test(spark, sf), X.D2_SPEC, "Random Forest")
    return S.decode(p, dim, "prediction", "predicted_label").select("rid", "prediction", "predicted_label")


@register("m16_feature_importance")
def m16(spark, sf):
    models = fitted_all(spark, sf, ML.PRESETS)
    return finish(ML.feature_importance(models, list(X.D2_FEATURES), spark))


@register("m19_cross_validation")
def m19(spark, sf):
    """Fold loop of forest fits over folds written once."""
    path = scratch_path(spark, "folds")  # ranked once; every fit and prediction reads the written folds
    S.stratified_folds(d2_written(spark, sf, "train"), X.D2_SPEC).write.partitionBy("fold").parquet(path)
    preds = ML.cross_validate(spark.read.parquet(path), X.D2_SPEC, ML.PRESETS["Random Forest"])
    per_fold = M.summary(M.confusion(preds, X.D2_CLASSES, ("model", "fold")), ("model", "fold"))
    return finish(per_fold.withColumn("fold", (F.col("fold") + 1).cast("int")))


@register("m20_cv_summary_fitted")
def m20f(spark, sf):
    return finish(M.cv_summary(m19(spark, sf).withColumn("fold", F.col("fold") - 1)))


def ablation_configs():
    feats = list(X.D2_FEATURES)
    return [("A_All_Features", feats)] + [(f"{chr(66 + i)}_No_{f}", [g for g in feats if g != f])
                                          for i, f in enumerate(feats)]


@register("m21_feature_ablation")
def m21(spark, sf):
    preds = ML.ablation(d2_written(spark, sf, "train"), d2_written(spark, sf, "test"), X.D2_SPEC,
                        ML.PRESETS["Random Forest"], ablation_configs())
    return finish(M.summary(M.confusion(preds, X.D2_CLASSES, ("model", "config")), ("model", "config")))


@register("m25_ovr_probabilities")
def m25(spark, sf):
    p = ML.predict(fitted(spark, sf, "One-vs-rest"), d2_test(spark, sf), X.D2_SPEC, "One-vs-rest")
    return finish(p.select("rid", "prediction", F.aggregate("probability", F.lit(0.0), lambda a, x: a + x).alias("prob_sum"),
                           (F.array_position("probability", F.array_max("probability")) - 1).cast("int").alias("argmax")))


# Bounds of the validated scoring input (quantity is 1..50 in lineitem).
D2_SCORING_SPEC = X.D2_SPEC.with_(bounds={"l_quantity": (1.0, 50.0)})


def d2_dirty(spark, sf):
    """D2 test rows with the quantity as text and D1-style dirt keyed by the row digest."""
    t = d2_test(spark, sf)
    h = F.substring(F.md5("rid"), 1, 2)
    q = (F.when(h == "00", F.lit("abc")).when(h == "01", F.lit("NaN")).when(h == "02", F.lit("-3"))
         .when(h == "03", F.lit(None).cast("string")).when(h == "04", F.lit("inf"))
         .otherwise(F.col("l_quantity").cast("string")))
    return t.select("rid", q.alias("l_quantity"), "l_discount", "l_tax")  # no label: rows to be scored


@register("m26_validated_scoring")
def m26(spark, sf):
    scored, rejected = ST.score_batch(d2_dirty(spark, sf), fitted(spark, sf, "Random Forest"), D2_SCORING_SPEC,
                                      "Random Forest")
    return finish(scored.select("rid", F.lit(True).alias("is_valid"), "prediction", "confidence",
                                F.lit(None).cast("string").alias("errors"))
                  .unionByName(rejected.select("rid", F.lit(False).alias("is_valid"), F.lit(None).cast("int").alias("prediction"),
                                               F.lit(None).cast("double").alias("confidence"), "errors")))


@register("m27_shapley")
def m27(spark, sf):
    """Interventional values over 16 background rows, of a Spark ML forest."""
    model = fitted(spark, sf, "Spark forest")
    bg = EX.background_rows(d2_written(spark, sf, "train"), list(X.D2_FEATURES), "rid", n=16)
    sh = EX.shapley(model, d2_test(spark, sf), list(X.D2_FEATURES), "rid", bg)
    return finish(EX.contributions_long(sh, list(X.D2_FEATURES), "rid"))


def tree_attributions(spark, sf):
    """Attribution of the predicted class of every test row by the ensembles themselves: the symmetric boosted preset
    (margins) and a Spark ML forest (probabilities)."""
    test, out = d2_test(spark, sf), None
    models = fitted_all(spark, sf, ["CatBoost-like", "Spark forest"])
    for name, m in models.items():
        sh = EX.tree_shap(m, test, X.D2_FEATURES, "rid").withColumn("model", F.lit(name))
        out = sh if out is None else out.unionByName(sh)
    return out


@register("m27_tree_attribution")
def m27t(spark, sf):
    sh = tree_attributions(spark, sf)
    named = EX.contributions_long(sh.withColumn("rid", F.struct("model", "rid")), list(X.D2_FEATURES), "rid")
    return finish(named.select("rid.model", "rid.rid", "feature", "contribution"))


@register("m27_attribution_check")
def m27c(spark, sf):
    """For each model: rows, rows with finite contributions, rows where base + contributions is the model's score."""
    sh = tree_attributions(spark, sf)
    finite = F.forall("contributions", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    total = F.aggregate("contributions", F.col("base"), lambda a, x: a + x)
    return sh.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(finite.cast("long")).alias("n_finite"),
                                   F.sum((F.abs(total - F.col("score")) < 1e-9).cast("long")).alias("n_additive"))


# Golden cases, quantities away from the class edges with the class they must get.
GOLDEN = ((3, 0), (5, 0), (7, 0), (9, 0), (13, 1), (15, 1), (17, 1), (19, 1), (23, 2), (25, 2), (27, 2), (29, 2),
          (33, 3), (35, 3), (37, 3), (39, 3), (43, 4), (45, 4), (47, 4), (49, 4))


@register("m29_golden_cases")
def m29(spark, sf):
    """Test rows with a golden quantity, the expected class from the list written in advance."""
    want = F.create_map(*[F.lit(x) for q, c in GOLDEN for x in (float(q), c)])
    test = d2_test(spark, sf).withColumn("expected", want[F.col("l_quantity")]).where("expected IS NOT NULL")
    pred = ML.predict(fitted(spark, sf, "CatBoost-like"), test, X.D2_SPEC, "CatBoost-like") \
        .select("rid", F.col("prediction").alias("predicted"))
    return finish(SC.golden_summary(SC.golden_cases(pred, test.select("rid", "expected"), "rid")))


@register("m30_streaming_scoring")
def m30(spark, sf):
    src = scratch_path(spark, "stream-in")
    files = max(4, -(-d2_test(spark, sf).count() // ST.ROWS_PER_FILE))  # several files -> several micro-batches
    d2_dirty(spark, sf).repartition(files).write.parquet(src)
    out = scratch_path(spark, "stream-out")
    schema = spark.read.parquet(src).schema
    ST.run_stream(spark, src, schema, fitted(spark, sf, "Random Forest"), D2_SCORING_SPEC, "Random Forest",
                  out, scratch_path(spark, "stream-ckpt"), min(files // 4, 2 * spark.sparkContext.defaultParallelism))
    return finish(ST.read_results(spark, out, "rid"))


# ---- M: exact counts of the fitted operators (every one has its SQL) ------------------------

def n_true(cond) -> F.Column:
    return F.coalesce(F.sum(cond.cast("long")), F.lit(0).cast("long"))


@register("m01_m02_scored_rows")
def m0102(spark, sf):
    """For each preset: test rows scored, rows whose probabilities sum to 1 and peak at the prediction, and whether the
    training loss of a boosted preset falls in every step."""
    models = fitted_all(spark, sf, ML.PRESETS)
    p = ML.predict_all(models, d2_test(spark, sf), X.D2_SPEC)
    total = F.aggregate("probability", F.lit(0.0), lambda a, x: a + x)
    ok = (F.abs(total - 1) < 1e-9) & (F.element_at("probability", F.col("prediction") + 1) == F.array_max("probability"))
    falls = {n: all(b < a for a, b in zip(m.losses, m.losses[1:])) for n, m in models.items()}
    rule = F.create_map(*[F.lit(x) for n, v in falls.items() for x in (n, v)])
    return (p.groupBy("model").agg(F.count(F.lit(1)).alias("n_rows"), n_true(ok).alias("n_ok"))
            .withColumn("loss_falls", rule[F.col("model")]))


@register("m05_decoded_rows")
def m05c(spark, sf):
    return m05(spark, sf).agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("rid").alias("n_ids"),
                              n_true(F.col("predicted_label") == F.concat(F.lit("class_"), F.col("prediction"))).alias("n_decoded"))


@register("m16_importance_check")
def m16c(spark, sf):
    return m16(spark, sf).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_features"), (F.abs(F.sum("normalized_importance") - 1) < 1e-5).alias("sums_to_one"),
        F.max_by("feature", "importance").alias("top_feature"))


@register("m19_fold_rows")
def m19c(spark, sf):
    """Held-out rows scored in each fold of the cross-validation, and that its accuracy lies in (0.9, 1]."""
    path = scratch_path(spark, "folds")
    S.stratified_folds(d2_written(spark, sf, "train"), X.D2_SPEC).write.partitionBy("fold").parquet(path)
    preds = ML.cross_validate(spark.read.parquet(path), X.D2_SPEC, ML.PRESETS["CatBoost-like"])
    good = F.avg((F.col("label") == F.col("prediction")).cast("int")) > 0.9
    return preds.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows"), good.alias("accurate"))


@register("m21_ablation_rows")
def m21c(spark, sf):
    """Test rows scored by each feature subset; only the one without the key feature is no good."""
    preds = ML.ablation(d2_written(spark, sf, "train"), d2_test(spark, sf), X.D2_SPEC, ML.PRESETS["CatBoost-like"], ablation_configs())
    good = F.avg((F.col("label") == F.col("prediction")).cast("int")) > 0.9
    return preds.groupBy("config").agg(F.count(F.lit(1)).alias("n_rows"), good.alias("accurate"))


@register("m25_ovr_check")
def m25c(spark, sf):
    p = m25(spark, sf)
    return p.agg(F.count(F.lit(1)).alias("n_rows"), n_true(F.abs(F.col("prob_sum") - 1) < 1e-6).alias("n_sum_one"),
                 n_true(F.col("argmax") == F.col("prediction")).alias("n_argmax"))


@register("m26_validated_counts")
def m26c(spark, sf):
    return m26(spark, sf).groupBy("is_valid").agg(F.count(F.lit(1)).alias("n_rows"), F.count("prediction").alias("n_scored"),
                                                  F.count("errors").alias("n_messages"))


@register("m30_streamed_counts")
def m30c(spark, sf):
    return m30(spark, sf).groupBy("is_valid").agg(F.count(F.lit(1)).alias("n_rows"), F.count("prediction").alias("n_scored"),
                                                  F.count("errors").alias("n_messages"))


@register("m22_stability_verdict_fitted")
def m22f(spark, sf):
    """The verdict from fitted evidence: cross-validation (M19), refits without the key feature (M21), importances
    and the lowest class score of the boosted preset that the reference explains. The evidence stands in the row."""
    name = "CatBoost-like"
    preset, model = ML.PRESETS[name], fitted(spark, sf, name)
    path = scratch_path(spark, "folds")
    S.stratified_folds(d2_written(spark, sf, "train"), X.D2_SPEC).write.partitionBy("fold").parquet(path)
    cv_preds = ML.cross_validate(spark.read.parquet(path), X.D2_SPEC, preset)
    cv = M.cv_summary(M.summary(M.confusion(cv_preds, X.D2_CLASSES, ("model", "fold")), ("model", "fold"))).where("metric = 'macro_f1'")
    subsets = [c for c in ablation_configs() if c[0].startswith(("A_", "B_"))]  # all features, and without the key feature
    preds = ML.ablation(d2_written(spark, sf, "train"), d2_test(spark, sf), X.D2_SPEC, preset, subsets)
    summ = M.summary(M.confusion(preds, X.D2_CLASSES, ("model", "config")), ("model", "config"))
    test = ML.predict(model, d2_test(spark, sf), X.D2_SPEC, name)
    classes = M.per_class(M.confusion(test, X.D2_CLASSES))
    share = ML.feature_importance({name: model}, list(X.D2_FEATURES), spark).where("feature = 'l_quantity'")
    parts = [named_values(cv, {"cv_macro_f1_mean": F.col("mean"), "cv_macro_f1_std": F.col("std")}),
             summ.select(F.when(F.col("config").startswith("A_"), "full_feature_macro_f1").otherwise("no_key_feature_macro_f1").alias("m"),
                         F.col("macro_f1").alias("v")),
             share.select(F.lit("key_feature_normalized_importance").alias("m"), F.col("normalized_importance").alias("v")),
             classes.agg(F.min("f1").alias("v")).select(F.lit("minimum_class_f1").alias("m"), "v")]
    evidence = parts[0]
    for x in parts[1:]:
        evidence = evidence.unionByName(x)
    names = ["cv_macro_f1_mean", "cv_macro_f1_std", "full_feature_macro_f1", "no_key_feature_macro_f1",
             "key_feature_normalized_importance", "minimum_class_f1"]
    return finish(M.stability_verdict(evidence.groupBy().pivot("m", names).agg(F.first("v")), "l_quantity"))


# ---- S: sources and sinks ----------------------------------------------------------------

PART_SCHEMA = T.StructType([
    T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()),
    T.StructField("p_brand", T.StringType()), T.StructField("p_type", T.StringType()),
    T.StructField("p_size", T.IntegerType()), T.StructField("p_retailprice", T.DoubleType())])


@register("s01_scan")
def s01(spark, sf):
    return IO.shape(IO.scan(spark, X.table_path(sf, "part"), "parquet", PART_SCHEMA), "part")


@register("s01_csv_scan")
def s01c(spark, sf):
    path = scratch_path(spark, "part-csv")
    X.load(spark, sf, "part").write.option("header", True).csv(path)
    back = IO.scan(spark, path, "csv", PART_SCHEMA)
    return finish(back.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("p_size").cast("bigint").alias("sum_size"),
                           F.count_distinct("p_brand").alias("n_brands"), F.sum("p_retailprice").alias("sum_price")))


@register("s02_dimension_scan")
def s02(spark, sf):
    nation = X.load(spark, sf, "nation")
    region = X.load(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    return IO.dimension_join(nation, region, "n_regionkey").select("n_nationkey", "n_name", "r_name")


@register("s03_preview")
def s03(spark, sf):
    return finish(IO.preview(X.load(spark, sf, "part"), "p_partkey", 5))


@register("s04_manifest")
def s04(spark, sf):
    expected = [f"{t}.parquet" for t in X.TABLES] + ["fertilizer.parquet"]
    return IO.manifest(spark, sf, expected, "*.parquet")


@register("s05_file_digests")
def s05(spark, sf):
    return IO.file_digests(spark, sf, "*.parquet")


def _fingerprints(spark, sf, tables: dict) -> DataFrame:
    out = None
    for name, df in tables.items():
        fp = IO.table_fingerprint(df, name)
        out = fp if out is None else out.unionByName(fp)
    return out


@register("s06_change_audit")
def s06(spark, sf):
    ld = lambda t: X.load(spark, sf, t)
    part2 = ld("part").withColumn("p_retailprice", F.when(F.col("p_partkey") % 100 == 0, F.col("p_retailprice") + 1)
                                  .otherwise(F.col("p_retailprice")))
    before = _fingerprints(spark, sf, {"region": ld("region"), "nation": ld("nation"), "part": ld("part"),
                                       "supplier": ld("supplier")})
    after = _fingerprints(spark, sf, {"region": ld("region"), "nation": ld("nation"), "part": part2,
                                      "customer": ld("customer")})
    return IO.change_audit(before, after)


def _written_split(spark, sf):
    sp = li_split(spark, sf)
    dim = S.label_dimension(sp, LI_FLAG)
    path = scratch_path(spark, "split-table")
    IO.write_split_table(S.encode(sp, X.LI_SPEC, dim), dim, path)
    return path


@register("s07_split_sink")
def s07(spark, sf):
    path = _written_split(spark, sf)
    return spark.read.parquet(f"{path}/labels")


@register("s07_split_rows")
def s07r(spark, sf):
    """All rows of the written split, read back: rows, distinct ids and sums by split and class, with the class's code."""
    rows = spark.read.parquet(f"{_written_split(spark, sf)}/rows")
    return finish(rows.groupBy("split", F.col("l_returnflag").alias("label"), F.col("code").cast("int").alias("code")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("rid").alias("n_ids"), F.sum("l_quantity").alias("sum_quantity"),
        F.sum("l_extendedprice").alias("sum_price")), 2)


@register("s08_split_reload")
def s08(spark, sf):
    path = _written_split(spark, sf)
    test = IO.read_split(spark, path, "test", [*X.LI_FEATURES, "l_returnflag"])
    return test.groupBy(F.col("l_returnflag").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("s09_report_sink")
def s09(spark, sf):
    rep = a05(spark, sf)
    path = scratch_path(spark, "report")
    IO.write_report(rep, path, "json")
    return spark.read.schema(rep.schema).json(path)


@register("s09_report_csv")
def s09c(spark, sf):
    """The rounded report written as CSV and read back."""
    rep = IO.round_report(a05(spark, sf), 6)
    path = scratch_path(spark, "report-csv")
    IO.write_report(rep, path, "csv")
    return finish(IO.scan(spark, path, "csv", rep.schema))


@register("s10_json_leaves")
def s10l(spark, sf):
    """Nested JSON made from the events: the flat map inside an object, an array with an object, a null, empty ones, and text
    that is no JSON."""
    nested = F.concat(F.lit('{"props":'), "props", F.lit(',"tags":["'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit(',{"k":['),
                      F.col("event_id").cast("string"), F.lit(',true]}],"none":null,"empty":[],"void":{}}'))
    text = F.when(F.col("event_id") % 17 == 0, F.lit("{broken")).otherwise(nested)
    return IO.json_leaves(X.load(spark, sf, "events").select("event_id", text.alias("doc")), "event_id", "doc")


@register("s10_json_entries")
def s10(spark, sf):
    return IO.json_entries(X.load(spark, sf, "events"), "event_id", "props", "bigint")


# ---- the same quantile queries under their second names ------------------------------------

@register("a04_describe_distributed")
def a04d(spark, sf):
    return finish(A.describe(li(spark, sf), X.LI_SPEC))


@register("a05_feature_summary_distributed")
def a05d(spark, sf):
    return finish(A.feature_summary(X.load(spark, sf, "part"), X.PT_SPEC))


@register("a07_class_summary_distributed")
def a07d(spark, sf):
    return finish(A.class_stats(li(spark, sf), X.LI_SPEC, five_number=True))


@register("a08_iqr_outliers_distributed")
def a08d(spark, sf):
    return finish(A.iqr_outliers(li(spark, sf), X.LI_SPEC))


@register("a12_box_stats_distributed")
def a12d(spark, sf):
    return finish(A.box_stats(li(spark, sf), X.LI_SPEC))


# ---- the V1-like case: labels without signal (lineitem return flag) -----------------------

LI_MODEL_SPEC = X.LI_SPEC.with_(features=("l_quantity", "l_discount", "l_tax"))


@register("m15_best_model_v1_fitted")
def m15f(spark, sf):
    """All presets of the first workflow fitted on lineitem's return flag (no signal: accuracy near
    the largest class share), evaluated in one job and selected by the V1 rule (weighted F1
    rounded to 4 decimals, ties by accuracy then name)."""
    path = scratch_path(spark, "li-split")
    IO.write_by(S.stratified_split(li(spark, sf).select("rid", *LI_MODEL_SPEC.features, "l_returnflag"), LI_MODEL_SPEC), "split", ("train", "test"), path)
    rows = spark.read.parquet(path)
    models = ML.fit_all(rows.where("split = 'train'"), LI_MODEL_SPEC, ML.V1_PRESETS)
    preds = ML.predict_all(models, rows.where("split = 'test'"), LI_MODEL_SPEC).drop("probability")
    return finish(M.select_best_v1(M.summary(M.confusion(preds, [0, 1, 2]))))
