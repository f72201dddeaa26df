"""Evaluation operators.

Every metric derives from **one** confusion table per (model[, fold]): the prediction table is
reduced by a partially-aggregated ``groupBy(model, label, prediction)`` (at most
models x k^2 rows), and everything after that runs on that tiny table. Any number of models,
folds or ablation configurations is evaluated in the same job by adding grouping columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltab.functions.exprs import safe_div

# Best-model reason texts, stability-verdict categories and thresholds.
REASON_BEST = ("Selected %s using Macro F1 as the primary criterion (%.4f), then Weighted F1 (%.4f), "
               "then Accuracy (%.4f).")
REASON_V1_TIED = ("Selected %s because it achieved the highest weighted F1-score (%.4f) among tied models, "
                  "with accuracy %.4f and favorable simplicity/stability.")
REASON_V1_SINGLE = "Selected %s because it achieved the highest weighted F1-score (%.4f) on the held-out test set."
REASON_V1_FOREST = " Random Forest was preferred as the simpler and more stable baseline."
VERDICT_B = "B. Stable but heavily dependent on {feature}"
VERDICT_C = "C. Highly sensitive to the train/test split"
VERDICT_A = "A. Stable and robust"
VERDICT_E = "E. Other"
B_MIN_CV_F1, B_MIN_F1_DROP, B_MIN_IMPORTANCE = 0.98, 0.2, 0.8
C_MAX_CV_STD = 0.03
A_MIN_CV_F1, A_MIN_CLASS_F1 = 0.99, 0.95

METRICS = ("accuracy", "weighted_precision", "weighted_recall", "weighted_f1",
           "macro_precision", "macro_recall", "macro_f1")


def _lits(values: Sequence) -> F.Column:
    return F.array(*[F.lit(v) for v in values])


def confusion(pred: DataFrame, classes: Sequence, group: Sequence[str] = ("model",)) -> DataFrame:
    """(group..., label, prediction, n) for the full k x k grid of every group, and for every
    other pair of values that occurs (labels or predictions outside ``classes``, nulls). One scan:
    the cells of a group and the empty grid are put together in one array."""
    group = list(group)
    counts = pred.groupBy(*group, "label", "prediction").agg(F.count(F.lit(1)).alias("n"))
    types = {c: pred.schema[c].dataType for c in ("label", "prediction")}
    known = _lits(classes)
    empty = F.flatten(F.transform(known, lambda a: F.transform(known, lambda b: F.struct(
        a.cast(types["label"]).alias("label"), b.cast(types["prediction"]).alias("prediction"), F.lit(0).cast("bigint").alias("n")))))
    cells = counts.groupBy(*group).agg(F.collect_list(F.struct("label", "prediction", "n")).alias("cells"))
    return (cells.select(*group, F.inline(F.concat("cells", empty)))
            .groupBy(*group, "label", "prediction").agg(F.sum("n").cast("bigint").alias("n")))


def per_class(conf: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """(group..., class, tp, support, predicted, precision, recall, f1), zero_division = 0."""
    group = list(group)
    zero = F.lit(0).cast("bigint")
    # each cell counts once as support of its label and once as a prediction of its predicted
    # class: one aggregation over the k^2 cells instead of three aggregates and two joins
    roles = conf.select(*group, F.inline(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("s"), zero.alias("p"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(zero).alias("t")),
        F.struct(F.col("prediction").alias("class"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")))))
    j = roles.groupBy(*group, "class").agg(F.sum("s").alias("support"), F.sum("p").alias("predicted"),
                                           F.sum("t").alias("tp"))
    p = safe_div(F.col("tp"), F.col("predicted"))
    r = safe_div(F.col("tp"), F.col("support"))
    return (j.withColumn("precision", p).withColumn("recall", r)
            .withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
            .select(*group, "class", F.col("tp").cast("bigint"), F.col("support").cast("bigint"),
                    F.col("predicted").cast("bigint"), "precision", "recall", "f1"))


def summary(conf: DataFrame, group: Sequence[str] = ("model",), classes: Sequence | None = None) -> DataFrame:
    """M07 accuracy, M08 support-weighted P/R/F1, M09 macro P/R/F1 over the labels present in
    actual or predicted values (sklearn's default when ``labels`` is not given). With ``classes``
    also the rows whose label, and whose prediction, is outside that domain."""
    group = list(group)
    pc = per_class(conf, group)
    seen = (F.col("support") > 0) | (F.col("predicted") > 0)
    return pc.groupBy(*group).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("weighted_precision"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("weighted_recall"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
        F.avg(F.when(seen, F.col("precision"))).alias("macro_precision"),
        F.avg(F.when(seen, F.col("recall"))).alias("macro_recall"),
        F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        *([] if classes is None else [
            F.coalesce(F.sum(F.when(F.coalesce(~F.col("class").isin(list(classes)), F.lit(True)), F.col(c))), F.lit(0))
            .cast("bigint").alias(n) for c, n in (("support", "n_unknown_labels"), ("predicted", "n_unknown_predictions"))]))


def classification_report(conf: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Per-class rows for all k classes plus ``accuracy`` (value in f1, support = total),
    ``macro avg`` (over all k classes) and ``weighted avg``."""
    group = list(group)
    pc = per_class(conf, group)
    rows = pc.select(*group, F.col("class").cast("string").alias("class"), "precision", "recall", "f1", "support")
    agg = pc.groupBy(*group).agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("total"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"))
    def row(name, p, r, f):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        F.col("total").cast("bigint").alias("support"))
    none = F.lit(None).cast("double")
    extra = agg.select(*group, F.inline(F.array(
        row("accuracy", none, none, F.col("tp") / F.col("total")),
        row("macro avg", F.col("mp"), F.col("mr"), F.col("mf")),
        row("weighted avg", F.col("wp"), F.col("wr"), F.col("wf")))))
    return rows.unionByName(extra)


def largest_confusions(conf: DataFrame, top: int = 10, group: Sequence[str] = ("model",)) -> DataFrame:
    """Off-diagonal cells with n > 0, top ``top`` per model by count, ties row-major."""
    group = list(group)
    w = Window.partitionBy(*group).orderBy(F.desc("n"), "label", "prediction")  # <= k^2 rows per model
    return (conf.where((F.col("label") != F.col("prediction")) & (F.col("n") > 0))
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))


def compare_models(summ: DataFrame) -> DataFrame:
    """One row per model, ranked by macro F1, weighted F1, accuracy (desc), model (asc)."""
    w = Window.orderBy(F.desc("macro_f1"), F.desc("weighted_f1"), F.desc("accuracy"), "model")  # one row per model
    return summ.withColumn("rank", F.row_number().over(w))


def select_best(summ: DataFrame) -> DataFrame:
    """The first row of M13 with the reason text."""
    best = compare_models(summ).where("rank = 1")
    return best.withColumn("reason", F.format_string(REASON_BEST, "model", "macro_f1", "weighted_f1", "accuracy")) \
        .drop("rank")


def select_best_v1(summ: DataFrame) -> DataFrame:
    """Metrics rounded to 4 decimals first; order by weighted F1, accuracy (desc), model;
    the reason text depends on whether the top F1 is tied, and on whether a forest won the tie."""
    r = summ.select("model", *[F.bround(c, 4).alias(c) for c in ("accuracy", "weighted_f1")])
    w = Window.orderBy(F.desc("weighted_f1"), F.desc("accuracy"), "model")
    t = (r.withColumn("rank", F.row_number().over(w))
         .withColumn("n_tied", F.count(F.lit(1)).over(Window.partitionBy("weighted_f1"))))
    b = t.where("rank = 1")
    forest = F.when(F.col("model") == "Random Forest", F.lit(REASON_V1_FOREST)).otherwise(F.lit(""))
    tied = F.concat(F.format_string(REASON_V1_TIED, "model", "weighted_f1", "accuracy"), forest)
    single = F.format_string(REASON_V1_SINGLE, "model", "weighted_f1")
    return b.select("model", "accuracy", "weighted_f1", F.col("n_tied").cast("bigint"),
                    F.when(F.col("n_tied") > 1, tied).otherwise(single).alias("reason"))


def easiest_hardest(conf: DataFrame, n: int = 3, group: Sequence[str] = ("model",)) -> DataFrame:
    """top/bottom ``n`` classes by (F1, recall, precision); ties by class."""
    group = list(group)
    pc = per_class(conf, group)
    up = Window.partitionBy(*group).orderBy(F.desc("f1"), F.desc("recall"), F.desc("precision"), "class")
    down = Window.partitionBy(*group).orderBy("f1", "recall", "precision", "class")
    e = pc.withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= n).withColumn("side", F.lit("easiest"))
    h = pc.withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= n).withColumn("side", F.lit("hardest"))
    cols = [*group, "side", "rank", "class", "f1", "recall", "precision"]
    return e.select(*cols).unionByName(h.select(*cols))


def heldout_sample(pred: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` test rows by key with actual, predicted and correctness."""
    top = pred.orderBy(key).limit(n)
    return top.select(F.row_number().over(Window.orderBy(key)).alias("row_number"), key,
                      F.col("label").alias("actual"), F.col("prediction").alias("predicted"),
                      (F.col("label") == F.col("prediction")).alias("correct"))


def cv_summary(fold_metrics: DataFrame, group: Sequence[str] = ("model",)) -> DataFrame:
    """Mean, sample std, min and max of each metric across folds."""
    group = list(group)
    long = fold_metrics.select(*group, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                         for m in METRICS])))
    return long.groupBy(*group, "metric").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                              F.min("value").alias("min"), F.max("value").alias("max"))


def stability_verdict(inputs: DataFrame, key_feature: str) -> DataFrame:
    """Ordered rules over one row of evidence (CV, ablation drop, importance, class F1)."""
    drop = F.col("full_feature_macro_f1") - F.col("no_key_feature_macro_f1")
    cat = (F.when((F.col("cv_macro_f1_mean") >= B_MIN_CV_F1) & (drop >= B_MIN_F1_DROP)
                  & (F.col("key_feature_normalized_importance") >= B_MIN_IMPORTANCE),
                  F.lit(VERDICT_B.format(feature=key_feature)))
           .when(F.col("cv_macro_f1_std") > C_MAX_CV_STD, F.lit(VERDICT_C))
           .when((F.col("cv_macro_f1_mean") >= A_MIN_CV_F1) & (F.col("minimum_class_f1") >= A_MIN_CLASS_F1),
                 F.lit(VERDICT_A))
           .otherwise(F.lit(VERDICT_E)))
    return inputs.select(cat.alias("category"), "cv_macro_f1_mean", "cv_macro_f1_std", "full_feature_macro_f1",
                         "no_key_feature_macro_f1", drop.alias("macro_f1_drop_without_key_feature"),
                         "key_feature_normalized_importance", "minimum_class_f1")
