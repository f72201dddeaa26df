"""Learning operators.

Forest and boosted presets are fitted by ``labeltab.operators.ensembles`` with the reference's numbers of trees and
steps; fits of several presets, folds or feature subsets run side by side. Two Spark ML presets stay beside them:
a random forest, and ``OneVsRest`` over binary boosted trees (M25 turns its margins into probabilities).
Predictions of all models / folds / configs are unioned into one long table and evaluated by
``labeltab.operators.metrics`` in a single job.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, OneVsRestModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltab.operators import ensembles as E
from labeltab.operators import trees as T
from labeltab.session import scratch_path
from labeltab.spec import TableSpec

Model = PipelineModel | E.TreeModel


@dataclass(frozen=True)
class Preset:
    name: str
    kind: str  # "forest", "boosting", or Spark ML's "rf" and "ovr_gbt"
    params: E.Forest | E.Boosting | dict


# Model presets (name, family, hyper-parameters) of the second and the first workflow.
PRESETS = {
    "Random Forest": Preset("Random Forest", "forest", E.Forest(200)),
    "LightGBM-like": Preset("LightGBM-like", "boosting", E.Boosting(200, "leaf", rate=0.05, leaves=31, min_rows=20)),
    "XGBoost-like": Preset("XGBoost-like", "boosting", E.Boosting(200, "level", rate=0.05, depth=4, l2=1.0, min_hessian=1.0,
                                                                 row_share=0.9, column_share=0.9)),
    "CatBoost-like": Preset("CatBoost-like", "boosting", E.Boosting(300, "symmetric", rate=0.05, depth=6, l2=3.0, min_hessian=0.0)),
}
V1_PRESETS = {
    "Random Forest": Preset("Random Forest", "forest", E.Forest(100, depth=12)),
    "LightGBM-like": Preset("LightGBM-like", "boosting", E.Boosting(100, "leaf", rate=0.1, leaves=31, min_rows=20)),
    "XGBoost-like": Preset("XGBoost-like", "boosting", E.Boosting(100, "level", rate=0.3, depth=6, l2=1.0, min_hessian=1.0)),
    "CatBoost-like": Preset("CatBoost-like", "boosting", E.Boosting(100, "symmetric", rate=0.1, depth=6, l2=3.0, min_hessian=0.0)),
}
SPARK_PRESETS = {
    "Spark forest": Preset("Spark forest", "rf", {"numTrees": 20, "maxDepth": 12, "maxBins": 64}),
    "One-vs-rest": Preset("One-vs-rest", "ovr_gbt", {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3, "subsamplingRate": 0.9,
                                                     "featureSubsetStrategy": "0.9", "maxBins": 64}),
}


#: model class that a preset's family must load as
KINDS = {"rf": RandomForestClassificationModel, "ovr_gbt": OneVsRestModel, "forest": E.Forest, "boosting": E.Boosting}
#: fits that run side by side
FITS = 8
#: rows in a partition of a Spark ML forest's training table
ROWS_PER_PARTITION = 1 << 19
#: equal rows that the row sampling of a one-vs-rest fit draws apart, for each cell
PARTS = 32


def label_column(df: DataFrame, spec: TableSpec, out: str = "label") -> DataFrame:
    """Class code as a double label (codes follow the alphabetical class order)."""
    classes = list(spec.expected_classes or [])
    if classes and all(isinstance(c, int) for c in classes):
        return df.withColumn(out, F.col(spec.target).cast("double"))
    ordered = sorted(str(c) for c in classes)
    m = F.create_map(*[x for i, c in enumerate(ordered) for x in (F.lit(c), F.lit(float(i)))])
    return df.withColumn(out, m[F.col(spec.target).cast("string")])


def make_pipeline(preset: Preset, features: Sequence[str], seed: int = 42, parallelism: int = 4) -> Pipeline:
    """A forest on the features, or one-vs-rest on their bins with the rows' weights."""
    cols = list(features) if preset.kind == "rf" else [f"__bin{i}" for i in range(len(features))]
    va = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="error")
    if preset.kind == "rf":
        clf = RandomForestClassifier(featuresCol="features", labelCol="label", seed=seed, **preset.params)
    else:
        gbt = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", seed=seed, **preset.params)
        clf = OneVsRest(classifier=gbt, featuresCol="features", labelCol="label", weightCol="weight", parallelism=parallelism)
    return Pipeline(stages=[va, clf])


def fit_ovr(data: DataFrame, features: Sequence[str], preset: Preset, seed: int) -> PipelineModel:
    """One-vs-rest from cells: all rows with the same bins and class are the same to a boosted tree, so they go in as one row of their
    number as weight, or as ``PARTS`` rows of nearly equal weights for the row sampling. The bins are those a fit
    would cut (``maxBins``, by quantiles); the model cuts new rows by the same edges. A fit's size depends on the bins, not the rows."""
    rows = E.binned(data, features, "label", preset.params["maxBins"])
    parts = F.least(F.col("w"), F.lit(PARTS).cast("long"))
    cols = [f"__bin{i}" for i in range(len(features))]
    cells = (rows.cells.withColumn("__n", parts).withColumn("__i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
             .select(*[F.col(f"b{i}").cast("double").alias(c) for i, c in enumerate(cols)], F.col("label").cast("double").alias("label"),
                     (F.floor(F.col("w") / F.col("__n")) + (F.col("__i") < F.col("w") % F.col("__n")).cast("long")).cast("double").alias("weight")))
    # a bin holds its upper edge; Spark's buckets hold their lower one
    splits = [[-math.inf, *[math.nextafter(float(e), math.inf) for e in edges], math.inf] for edges in rows.edges]
    cut = Bucketizer(splitsArray=[s if len(s) > 2 else [-math.inf, math.inf, math.inf] for s in splits],
                     inputCols=list(features), outputCols=cols, handleInvalid="error")
    cells = cells.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return PipelineModel([cut, *make_pipeline(preset, features, seed).fit(cells).stages])
    finally:
        cells.unpersist()


def fit(train: DataFrame, spec: TableSpec, preset: Preset, features: Sequence[str] | None = None) -> Model:
    """Fit one preset on the training rows."""
    feats = list(features or spec.features)
    data = label_column(train, spec).select(*feats, "label")
    if preset.kind in ("forest", "boosting"):
        return E.fit(data, feats, "label", len(class_names(spec)), preset.params)
    if preset.kind == "ovr_gbt":
        return fit_ovr(data, feats, preset, spec.seed)
    parts = -(-data.count() // ROWS_PER_PARTITION)
    if parts > data.rdd.getNumPartitions():  # a task reads its whole partition in every pass
        data = data.repartition(parts)
    data = data.persist(StorageLevel.MEMORY_AND_DISK)  # iterative passes
    try:
        return make_pipeline(preset, feats, spec.seed).fit(data)
    finally:
        data.unpersist()


def side_by_side(fits: Sequence[Callable[[], Model]]) -> list[Model]:
    """Run the fits, ``FITS`` at a time; results in order."""
    with ThreadPoolExecutor(FITS) as pool:
        return list(pool.map(lambda f: f(), fits))


def fit_all(train: DataFrame, spec: TableSpec, presets: dict[str, Preset] | None = None) -> dict[str, Model]:
    """The model registry fitted on the training rows only. Tree presets of the same bins share the binned rows."""
    presets = presets or PRESETS
    k, shared = len(class_names(spec)), {}
    for b in {p.params.bins for p in presets.values() if p.kind in ("forest", "boosting")}:
        shared[b] = binned(train, spec, spec.features, b)

    def one(p: Preset) -> Model:
        return E.fit_binned(shared[p.params.bins], k, p.params) if p.kind in ("forest", "boosting") else fit(train, spec, p)

    return dict(zip(presets, side_by_side([lambda p=p: one(p) for p in presets.values()])))


def binned(train: DataFrame, spec: TableSpec, features: Sequence[str], bins: int) -> E.Binned:
    return E.binned(label_column(train, spec).select(*features, "label"), list(features), "label", bins)


def class_names(spec: TableSpec) -> list[str]:
    """Class names by code, in the order of ``label_column``."""
    classes = list(spec.expected_classes or [])
    return [str(c) for c in (classes if all(isinstance(c, int) for c in classes) else sorted(str(c) for c in classes))]


def _save(m: Model, path: str) -> int:
    spark = SparkSession.getActiveSession()
    kind = type(_clf_stage(m) if isinstance(m, PipelineModel) else m.params).__name__
    spark.createDataFrame([(kind,)], "kind string").coalesce(1).write.mode("overwrite").json(os.path.join(path, "kind"))
    if isinstance(m, PipelineModel):
        m.write().overwrite().save(os.path.join(path, "pipeline"))
        return len(m.stages)
    spark.createDataFrame(T.node_table(m.trees)).coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "nodes"))
    meta = (list(m.features), [float(x) for x in m.trees.base], m.trees.softmax,
            [float(x) for x in m.losses], [float(x) for x in m.gains])
    (spark.createDataFrame([meta], "features array<string>, base array<double>, softmax boolean, "
                                   "losses array<double>, gains array<double>")
     .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "ensemble")))
    return len(m.trees.root)


def save_models(models: dict[str, Model], base: str, spec: TableSpec) -> list:
    """Persist each fitted model under ``base`` (a shared folder) with its class names by
    code; returns (model, path, number of stages or trees)."""
    out = []
    for name, m in models.items():
        path = os.path.join(base, name.replace(" ", "_"))
        n = _save(m, path)
        spark = SparkSession.getActiveSession()
        (spark.createDataFrame(list(enumerate(class_names(spec))), "code int, label string")
         .write.mode("overwrite").parquet(os.path.join(path, "classes")))
        out.append((name, path, n))
    return out


def save_best(models: dict[str, Model], best: str, base: str, spec: TableSpec) -> str:
    """The selected model in a folder of its own, with its name."""
    path = os.path.join(base, "best_model")
    (_, saved, _), = save_models({"model": models[best]}, path, spec)
    SparkSession.getActiveSession().createDataFrame([(best,)], "model string").write.mode("overwrite").json(os.path.join(path, "name"))
    return saved


def _clf_stage(model: PipelineModel):
    return model.stages[-1]


def load_checked(path: str, spec: TableSpec, preset: Preset) -> Model:
    """Load a saved model; a wrong model kind, feature order or encoder raises."""
    spark, kind = SparkSession.getActiveSession(), KINDS[preset.kind]
    found = spark.read.schema("kind string").json(os.path.join(path, "kind")).first().kind
    if found != kind.__name__:
        raise TypeError(f"{path}: expected {kind.__name__}, found {found}")
    if preset.kind in ("rf", "ovr_gbt"):
        m = PipelineModel.load(os.path.join(path, "pipeline"))
        clf, feats = _clf_stage(m), m.stages[0].getInputCols()
        n_classes = len(clf.models) if isinstance(clf, OneVsRestModel) else clf.numClasses
    else:
        meta = spark.read.parquet(os.path.join(path, "ensemble")).first()
        feats, n_classes = list(meta.features), len(meta.base)
        nodes = spark.read.parquet(os.path.join(path, "nodes")).toArrow()  # the nodes of one model
        m = E.TreeModel(tuple(feats), T.from_table(nodes, meta.base, meta.softmax), tuple(meta.losses), tuple(meta.gains), preset.params)
    if feats != list(spec.features):
        raise ValueError(f"{path}: feature order mismatch, expected {list(spec.features)}, found {feats}")
    saved = spark.read.parquet(os.path.join(path, "classes")).orderBy("code")
    names = [r.label for r in saved.collect()]  # one row per class of the model
    if names != class_names(spec) or n_classes != len(names):
        raise ValueError(f"{path}: encoder classes mismatch, expected {class_names(spec)}, found {names} "
                         f"and {n_classes} model classes")
    return m


def ovr_probabilities(raw: str = "rawPrediction") -> F.Column:
    """OneVsRest gives one margin per class; p_k = sigmoid(2 m_k), normalised to sum 1."""
    sig = F.transform(vector_to_array(F.col(raw)), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    tot = F.aggregate(sig, F.lit(0.0), lambda a, x: a + x)
    return F.transform(sig, lambda x: x / tot)


def transform(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``model.transform``; the margins of a one-vs-rest model come from its binary models in Spark (pyspark's own ``transform``
    passes every row through Python once a class). The lower class wins a tie."""
    clf = _clf_stage(model)
    if not isinstance(clf, OneVsRestModel):
        return model.transform(df)
    for stage in model.stages[:-1]:
        df = stage.transform(df)
    kept = df.columns
    for i, m in enumerate(clf.models):
        df = m.copy().setPredictionCol("").setProbabilityCol("").setRawPredictionCol(f"__raw{i}").transform(df)
    margins = F.array(*[vector_to_array(F.col(f"__raw{i}"))[1] for i in range(len(clf.models))])
    return (df.select(*kept, margins.alias("__margins"))
            .select(*kept, array_to_vector("__margins").alias("rawPrediction"),
                    (F.array_position("__margins", F.array_max("__margins")) - 1).cast("double").alias("prediction")))


def predict(model: Model, df: DataFrame, spec: TableSpec, name: str, key: str | None = None,
            keep: Sequence[str] = ()) -> DataFrame:
    """(model, key, label, prediction, probability) for every row of ``df``; without ``label``
    if the rows carry none (new rows to be scored). Ties of the probability go to the lower class."""
    key = key or spec.key
    labelled = spec.target in df.columns
    rows = label_column(df, spec) if labelled else df
    if isinstance(model, E.TreeModel):
        used = dict.fromkeys([key, *model.features, *(["label"] if labelled else []), *keep])
        scored = T.score_rows(model.trees, rows.select(*used), model.features, "probability")
        prob = F.col("probability")
        scored = scored.withColumn("prediction", F.array_position(prob, F.array_max(prob)) - 1)
    else:
        scored = transform(model, rows)
        prob = ovr_probabilities() if isinstance(_clf_stage(model), OneVsRestModel) else vector_to_array("probability")
    return scored.select(F.lit(name).alias("model"), key, *([F.col("label").cast("int").alias("label")] if labelled else []),
                         F.col("prediction").cast("int").alias("prediction"), prob.alias("probability"), *keep)


def predict_all(models: dict[str, Model], df: DataFrame, spec: TableSpec) -> DataFrame:
    out = None
    for name, m in models.items():
        p = predict(m, df, spec, name)
        out = p if out is None else out.unionByName(p)
    return out


def feature_importance(models: dict[str, Model], features: Sequence[str], spark) -> DataFrame:
    """Raw importance per (model, feature) and importance / total (0 when total is 0): the summed gain of an
    ensemble's splits; for OneVsRest the mean over the binary models. Importances are model metadata (f values)."""
    rows = []
    for name, m in models.items():
        if isinstance(m, E.TreeModel):
            imp = [float(x) for x in m.gains]
        elif isinstance(_clf_stage(m), OneVsRestModel):
            vecs = [sub.featureImportances.toArray() for sub in _clf_stage(m).models]
            imp = [float(sum(v[i] for v in vecs) / len(vecs)) for i in range(len(features))]
        else:
            imp = [float(x) for x in _clf_stage(m).featureImportances.toArray()]
        total = sum(x for x in imp if x == x)
        for f, x in zip(features, imp):
            rows.append((name, f, x, (x / total) if total > 0 else 0.0))
    return spark.createDataFrame(rows, "model string, feature string, importance double, normalized_importance double")


def cross_validate(train_with_folds: DataFrame, spec: TableSpec, preset: Preset, n_folds: int | None = None) -> DataFrame:
    """Per fold, fit on the other folds and predict the held-out fold; returns the union
    of all fold predictions with a ``fold`` column (evaluate with metrics.summary)."""
    k = n_folds or spec.n_folds
    folds = [train_with_folds.where(F.col("fold") != i) for i in range(k)]
    out = None
    for i, m in enumerate(side_by_side([lambda t=t: fit(t, spec, preset) for t in folds])):
        p = predict(m, train_with_folds.where(F.col("fold") == i), spec, preset.name).withColumn("fold", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def ablation(train: DataFrame, test: DataFrame, spec: TableSpec, preset: Preset,
             configs: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """Refit on each feature subset, predict the same test rows; ``config`` column."""
    if preset.kind in ("forest", "boosting"):  # one binning of all rows, narrowed to each subset
        used = [f for f in spec.features if any(f in feats for _, feats in configs)]
        rows, k = binned(train, spec, used, preset.params.bins), len(class_names(spec))
        models = side_by_side([lambda f=feats: E.fit_binned(rows.only(f), k, preset.params) for _, feats in configs])
    else:
        models = side_by_side([lambda f=feats: fit(train, spec, preset, f) for _, feats in configs])
    out = None
    for (name, _), m in zip(configs, models):
        p = predict(m, test, spec, preset.name).withColumn("config", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out
