"""Formula tests against numbers the reference recorded (inputs copied from its reports)."""

import math

import pytest
from pyspark.sql import functions as F

from labeltab.operators import metrics as M
from labeltab.operators import profile as A
from labeltab.operators import relevance as R
from labeltab.operators import split as S
from labeltab.spec import TableSpec

CROPS = ["Banana", "Jute", "Maize", "Mango", "Pineapple", "Potato", "Strawberry", "Sugarcane", "Wheat"]


def test_split_quotas_match_recorded_train_counts():
    counts = dict(zip(CROPS, [289, 247, 607, 255, 181, 324, 443, 180, 365]))
    q = S.train_quotas(counts, 0.2)
    assert [q[c] for c in CROPS] == [231, 198, 485, 204, 145, 259, 354, 144, 292]


def test_fold_sizes_match_recorded(spark):
    quotas = [231, 198, 485, 204, 145, 259, 354, 144, 292]
    rows = [(f"{c}-{i}", c) for c, n in zip(CROPS, quotas) for i in range(n)]
    df = spark.createDataFrame(rows, "rid string, crop string")
    spec = TableSpec(features=(), target="crop", key="rid")
    sizes = S.fold_sizes(S.stratified_folds(df, spec)).orderBy("fold").collect()
    assert [r.n_validation for r in sizes] == [463, 463, 462, 462, 462]
    assert [r.n_train for r in sizes] == [1849, 1849, 1850, 1850, 1850]


def test_split_exact_quotas_on_rows(spark):
    counts = dict(zip(CROPS, [289, 247, 607, 255, 181, 324, 443, 180, 365]))
    rows = [(f"{c}-{i}", c) for c, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "rid string, crop string")
    spec = TableSpec(features=(), target="crop", key="rid")
    got = {(r.crop, r.split): r["count"] for r in S.stratified_split(df, spec).groupBy("crop", "split").count().collect()}
    assert [got[(c, "train")] for c in CROPS] == [231, 198, 485, 204, 145, 259, 354, 144, 292]
    assert [got[(c, "test")] for c in CROPS] == [58, 49, 122, 51, 36, 65, 89, 36, 73]


def test_categorical_relevance_season(spark):
    # recorded crosstab Season x crop (counts) -> recorded chi2, Cramer's V, MI / H(target)
    table = {"Kharif": [680, 650, 668, 669], "Rabi": [683, 623, 705, 661], "Zaid": [680, 651, 635, 695]}
    crops = ["Maize", "Rice", "Soybean", "Wheat"]
    rows = [(s, c) for s, ns in table.items() for c, n in zip(crops, ns) for _ in range(n)]
    df = spark.createDataFrame(rows, "season string, crop string")
    spec = TableSpec(features=(), target="crop")
    r = R.categorical_relevance(df, spec, ["season"]).first()
    assert r.chi2 == pytest.approx(5.373470401585979, abs=1e-9)
    assert r.dof == 6
    assert r.cramers_v == 0.0
    assert r.nmi_target == pytest.approx(0.00024223164730343137, rel=1e-9)
    assert r.max_purity == pytest.approx(0.2638473053892216, rel=1e-12)
    assert r.largest_category_n == 2672


def _catboost_predictions(spark):
    diag = [57, 48, 120, 51, 36, 65, 89, 36, 73]
    rows = []
    for i, n in enumerate(diag):
        rows += [("CatBoost", i, i)] * n
    for a, p in [(0, 5), (1, 3), (2, 4), (2, 6)]:
        rows.append(("CatBoost", a, p))
    return spark.createDataFrame(rows, "model string, label int, prediction int")


def test_metrics_from_recorded_confusion_matrix(spark):
    conf = M.confusion(_catboost_predictions(spark), list(range(9)))
    s = M.summary(conf).first()
    assert s.accuracy == pytest.approx(0.9930915371329879, abs=1e-12)
    assert s.macro_precision == pytest.approx(0.9919421752755085, abs=1e-12)
    assert s.macro_recall == pytest.approx(0.9939952238668219, abs=1e-12)
    assert s.macro_f1 == pytest.approx(0.9929003398555066, abs=1e-12)
    assert s.weighted_precision == pytest.approx(0.9932167882945087, abs=1e-12)
    assert s.weighted_f1 == pytest.approx(0.9930924815991552, abs=1e-12)
    assert conf.count() == 81


def test_hardest_classes_from_recorded_matrix(spark):
    preds = _catboost_predictions(spark).withColumn(
        "label", F.array(*[F.lit(c) for c in CROPS])[F.col("label")]).withColumn(
        "prediction", F.array(*[F.lit(c) for c in CROPS])[F.col("prediction")])
    conf = M.confusion(preds, CROPS)
    hard = M.easiest_hardest(conf).where("side = 'hardest'").orderBy("rank").collect()
    assert [r["class"] for r in hard] == ["Pineapple", "Jute", "Mango"]


def test_model_selection_recorded_comparison(spark):
    rows = [("CatBoost", 0.9930915371329879, 0.9930924815991552, 0.9929003398555066),
            ("XGBoost", 0.9930915371329879, 0.9930827629363234, 0.9928649914769705),
            ("LightGBM", 0.9879101899827288, 0.9878614750169015, 0.9858944522873679),
            ("Random Forest", 0.9827288428324698, 0.9827208970032907, 0.978070512428721)]
    summ = spark.createDataFrame(rows, "model string, accuracy double, weighted_f1 double, macro_f1 double")
    best = M.select_best(summ).first()
    assert best.model == "CatBoost"
    assert best.reason.startswith("Selected CatBoost using Macro F1 as the primary criterion (0.9929)")


def test_cv_summary_recorded_folds(spark):
    acc = [0.9956803455723542, 0.9935205183585313, 0.9956709956709957, 0.987012987012987, 0.9826839826839827]
    rows = [("m", i, a, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) for i, a in enumerate(acc)]
    cols = "model string, fold int, accuracy double, weighted_precision double, weighted_recall double, " \
           "weighted_f1 double, macro_precision double, macro_recall double, macro_f1 double"
    r = M.cv_summary(spark.createDataFrame(rows, cols)).where("metric = 'accuracy'").first()
    assert r["mean"] == pytest.approx(0.990914, abs=1e-6)
    assert r["std"] == pytest.approx(0.005811, abs=1e-6)


def test_stability_verdict_recorded_inputs(spark):
    cols = "cv_macro_f1_mean double, cv_macro_f1_std double, full_feature_macro_f1 double, " \
           "no_key_feature_macro_f1 double, key_feature_normalized_importance double, minimum_class_f1 double"
    cases = [((0.9896, 0.0073, 0.9929, 0.3918, 0.9531, 0.9863), "B"),
             ((0.95, 0.05, 0.95, 0.9, 0.5, 0.9), "C"),
             ((0.995, 0.001, 0.995, 0.99, 0.3, 0.97), "A"),
             ((0.95, 0.01, 0.95, 0.9, 0.5, 0.9), "E")]
    for vals, want in cases:
        got = M.stability_verdict(spark.createDataFrame([vals], cols), "Soil_Moisture").first().category
        assert got.startswith(want)


def test_range_overlap_recorded_pair(spark):
    rows = [("Banana", 42.94), ("Banana", 92.31), ("Jute", 68.25), ("Jute", 95.0)]
    df = spark.createDataFrame(rows, "crop string, Humidity double")
    spec = TableSpec(features=("Humidity",), target="crop")
    r = R.range_overlaps(df, spec).first()
    assert r.overlap and r.lo == 68.25 and r.hi == 92.31
    assert r.width == pytest.approx(24.06, abs=1e-9)
    assert round(r.pct_of_smaller, 2) == 89.94


def test_class_balance_ratio(spark):
    counts = dict(zip(["Banana", "Jute", "Maize", "Mango", "Pineapple", "Potato", "Strawberry", "Sugercane", "Wheat"],
                      [289, 247, 608, 255, 181, 324, 443, 180, 365]))
    df = spark.createDataFrame([(c,) for c, n in counts.items() for _ in range(n)], "crop string")
    r = A.class_balance(df, TableSpec(features=(), target="crop")).first()
    assert r.largest_label == "Maize" and r.largest_n == 608
    assert round(r.imbalance_ratio, 2) == 3.38


def test_anova_matches_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(0, 1, 40), "b": rng.normal(0.5, 2, 25), "c": rng.normal(1, 1.5, 35)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    r = R.anova(df, TableSpec(features=("x",), target="g")).first()
    allv = np.concatenate(list(groups.values()))
    ssb = sum(len(v) * (v.mean() - allv.mean()) ** 2 for v in groups.values())
    ssw = sum(((v - v.mean()) ** 2).sum() for v in groups.values())
    f = (ssb / 2) / (ssw / (len(allv) - 3))
    assert r.f_stat == pytest.approx(f, rel=1e-10)
    assert r.eta_squared == pytest.approx(ssb / (ssb + ssw), rel=1e-10)
    p = R.anova_pvalue(R.anova(df, TableSpec(features=("x",), target="g"))).first().p_value
    assert 0.0 <= p <= 1.0
    # F(2, 97) survival at the 5% critical value 3.0902
    assert R.f_survival(3.0902, 2, 97) == pytest.approx(0.05, abs=5e-4)
    assert math.isclose(R.f_survival(0.0, 2, 97), 1.0)
