"""Per-row attribution for the predicted class.

``tree_shap`` takes it from the trees and their covers (``labeltab.operators.trees``): no background rows, any number of
features. ``shapley`` is the interventional variant for any model, over feature coalitions.

Every attribution is a linear combination of coalition values: phi_i = sum_S coef[S, i] v(S),
where v(S) is the mean model probability of the row's predicted class when the features in S
come from the row and the rest from a background row. The coefficient table is built on the
driver (coalitions x features, small):

* exact — every coalition, Shapley weights |S|! (f-|S|-1)! / f! (used up to ``exact_max``
  features);
* sampled — ``permutations`` seeded random orders; each order telescopes from v(empty) to
  v(all), so additivity (sum phi = v(all) - v(empty)) still holds exactly.

A Spark ML forest on the features themselves is worked out by the cells of its thresholds (``trees.Coalitions``): the model
compares features with thresholds only, so the probabilities of a coalition are worked out once for each cell of
the coalition's features and not once a row. For any other model the rows are expanded to coalitions x
background rows with ``explode`` (no join) and scored by one ``model.transform``. One ``groupBy(row)`` of
coefficient-weighted sums ends both (one row per input row is shuffled).

The background set is a sampling operator by nature: the ``n`` rows with the lowest seeded
digest (a bounded top-k, passed as literals).
"""

from __future__ import annotations

import math
import random
from collections import defaultdict
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import OneVsRestModel, RandomForestClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltab.functions.exprs import hash_order_key
from labeltab.operators import trees as T
from labeltab.operators.ensembles import TreeModel
from labeltab.operators.models import Model, ovr_probabilities, transform
from labeltab.session import scratch_path


def background_rows(df: DataFrame, features: Sequence[str], key: str, n: int = 16, seed: int = 42) -> list[list[float]]:
    rows = (df.select(key, *features).withColumn("__h", hash_order_key(seed, key))
            .orderBy("__h").limit(n).collect())
    return [[float(r[f]) for f in features] for r in rows]


def coalition_coefficients(f: int, exact_max: int = 10, permutations: int = 64,
                           seed: int = 42) -> dict[int, list[float]]:
    """mask -> per-feature coefficient, exact or from sampled permutations."""
    coef: dict[int, list[float]] = defaultdict(lambda: [0.0] * f)
    if f <= exact_max:
        for s in range(1 << f):
            size = bin(s).count("1")
            for i in range(f):
                if s >> i & 1:
                    continue
                w = math.factorial(size) * math.factorial(f - size - 1) / math.factorial(f)
                coef[s | (1 << i)][i] += w
                coef[s][i] -= w
        return dict(coef)
    rng = random.Random(seed)
    for _ in range(permutations):
        order = list(range(f))
        rng.shuffle(order)
        mask = 0
        for i in order:
            coef[mask | (1 << i)][i] += 1.0 / permutations
            coef[mask][i] -= 1.0 / permutations
            mask |= 1 << i
    return dict(coef)


def _prob_of(model: PipelineModel, cls: str) -> F.Column:
    clf = model.stages[-1]
    probs = ovr_probabilities() if isinstance(clf, OneVsRestModel) else vector_to_array("probability")
    return F.element_at(probs, F.col(cls) + 1)


def _forest(model: PipelineModel, spark: SparkSession, features: Sequence[str]) -> T.Trees | None:
    """The trees of a Spark ML forest on the features themselves whose thresholds leave few cells; none for other models."""
    if [type(s) for s in model.stages] != [VectorAssembler, RandomForestClassificationModel]:
        return None
    va, clf = model.stages
    plain = (va.getInputCols() == list(features) and va.getOutputCol() == clf.getFeaturesCol() and va.getHandleInvalid() == "error"
             and not clf.isSet("thresholds") and clf.totalNumNodes * 8 * (5 + clf.numClasses) <= T.MODEL_BYTES)
    if not plain:
        return None
    path = scratch_path(spark, "forest")
    clf.write().overwrite().save(path)
    if T.has_categories(spark, path):
        return None
    trees = T.from_forest(spark, path, votes=True)
    return trees if T.n_cells(trees, len(features)) <= T.CELLS else None


def shapley(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str,
            background: list[list[float]], exact_max: int = 10, permutations: int = 64,
            seed: int = 42) -> DataFrame:
    """(key, predicted, score, base, contributions array) for every row of ``df``.

    phi_i = sum_S coef[S, i] * mean_b p(S, b): for a forest from its cells, else from the expanded rows. Both give
    terms of f + 2 sums, added by one ``groupBy(row)``."""
    f = len(features)
    B = len(background)
    coef = {(1 << f) - 1: [0.0] * f, 0: [0.0] * f} | coalition_coefficients(f, exact_max, permutations, seed)
    trees = _forest(model, df.sparkSession, features) if B else None
    if trees is None:
        rows, terms = _expanded(model, df, features, key, background, coef)
    else:
        rows = T.coalition_rows(trees, df, features, key, background, coef)
        terms = {c: F.col(c) for c in rows.columns[2:]}
    agg = rows.groupBy(key, "__c").agg(*[F.sum(c).alias(n) for n, c in terms.items()])
    return agg.select(key, F.col("__c").alias("predicted"), (F.col("s_full") / B).alias("score"),
                      (F.col("s_empty") / B).alias("base"),
                      F.array(*[F.col(f"phi{i}") / B for i in range(f)]).alias("contributions"))


def _expanded(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, background: list[list[float]],
              coef: dict[int, list[float]]) -> tuple[DataFrame, dict[str, F.Column]]:
    """A scored row for each row, coalition and background row, and the terms of its sums: linear, so map-side partial aggregation
    collapses each row's expansion before the one shuffle. Coefficients are literal arrays indexed by coalition
    (coalitions x features)."""
    f = len(features)
    B = len(background)
    full, empty = (1 << f) - 1, 0
    masks = sorted(coef)
    first = transform(model, df.select(key, *features)).select(key, *features, F.col("prediction").cast("int").alias("__c"))
    idx = F.explode(F.sequence(F.lit(0), F.lit(len(masks) * B - 1)))
    exp = (first.select(key, "__c", *features, idx.alias("__i"))
           .withColumn("__k", (F.col("__i") / B).cast("int"))
           .withColumn("__m", F.array(*[F.lit(m) for m in masks])[F.col("__k")])
           .withColumn("__b", F.col("__i") % B))
    cols = {}
    for i, feat in enumerate(features):
        bg = F.array(*[F.lit(row[i]) for row in background])[F.col("__b")]
        cols[feat] = F.when(F.shiftright(F.col("__m"), i) % 2 == 1, F.col(feat).cast("double")).otherwise(bg)
    scored = transform(model, exp.select(key, "__c", "__k", "__m", *[cols[ft].alias(ft) for ft in features]))
    p = _prob_of(model, "__c")
    terms = {f"phi{i}": F.array(*[F.lit(coef[m][i]) for m in masks])[F.col("__k")] * p for i in range(f)}
    terms |= {"s_full": F.when(F.col("__m") == full, p), "s_empty": F.when(F.col("__m") == empty, p)}
    return scored, terms


def tree_shap(model: Model, df: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    """(key, predicted, score, base, contributions array) for every row of ``df``: path-dependent Shapley values of
    a tree ensemble or a Spark ML forest. ``score`` is the margin (boosting) or probability (forest) of the predicted
    class, ``base`` its value with all features unknown; base + contributions = score."""
    if isinstance(model, TreeModel):
        trees = model.trees
    else:
        path = scratch_path(df.sparkSession, "forest")
        model.stages[-1].write().overwrite().save(path)
        trees = T.from_forest(df.sparkSession, path)
    return T.attribute_rows(trees, df, features, key)


def class_attributions(attributed: DataFrame, classes: Sequence[str], label: str) -> DataFrame:
    """Rows attributed to one class by name; a name that is not exactly one of the classes raises."""
    at = [i for i, c in enumerate(classes) if c == label]
    if len(at) != 1:
        raise ValueError(f"predicted class not found among the classes: {label}")
    return attributed.where(F.col("predicted") == at[0])


def contributions_long(sh: DataFrame, features: Sequence[str], key: str) -> DataFrame:
    names = F.array(*[F.lit(x) for x in features])
    return sh.select(key, F.posexplode("contributions").alias("i", "contribution")) \
        .select(key, names[F.col("i")].alias("feature"), "contribution")
