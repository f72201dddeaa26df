"""Role tables built from the driver's parquet tables.

* D1 — a dirty labelled table derived from ``orders`` (dirt injected deterministically by key);
* D2 — a separable labelled table derived from ``lineitem`` (ordered, slightly overlapping classes);
* D3 — rule "models" scored on D2, so every metric is deterministic.

All are lazy DataFrames over the whole source table; nothing is sampled or capped.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltab.spec import TableSpec

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# The order-priority domain of the orders table and the D1 misspelling fix.
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
D1_LABEL_FIXES = {"5-LWO": "5-LOW"}
D1_BOUNDS = {"f1": (0.0, 500000.0)}
D2_FEATURES = ("l_quantity", "l_discount", "l_tax")
D2_CLASSES = (0, 1, 2, 3, 4)
LI_FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
RULE_MODELS = ("m_const", "m_exact", "m_shift")


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


# ---- specs -------------------------------------------------------------------------------

D1_SPEC = TableSpec(features=("f1",), target="label", key="row_id", bounds=D1_BOUNDS,
                    label_fixes=D1_LABEL_FIXES, expected_classes=PRIORITIES, name="d1")
LI_SPEC = TableSpec(features=LI_FEATURES, target="l_returnflag", key="rid",
                    expected_classes=("A", "N", "R"), name="lineitem")
D2_SPEC = TableSpec(features=D2_FEATURES, target="cls", key="rid", expected_classes=D2_CLASSES,
                    name="d2")
OD_SPEC = TableSpec(features=("o_totalprice",), target="o_orderpriority", key="o_orderkey",
                    expected_classes=PRIORITIES, name="orders")
PT_SPEC = TableSpec(features=("p_size", "p_retailprice"), target="p_brand", key="p_partkey", name="part")
EV_SPEC = TableSpec(features=("value",), target="event_type", key="event_id", name="events")


# ---- D1 ----------------------------------------------------------------------------------

def d1(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    p = F.col("o_orderpriority")
    f1 = (F.when(k % 97 == 0, F.lit(None).cast("string"))
          .when(k % 89 == 0, F.lit("  "))
          .when(k % 83 == 0, F.lit("abc"))
          .when(k % 79 == 0, F.lit("NaN"))
          .when(k % 73 == 0, F.lit("inf"))
          .when(k % 71 == 0, F.lit("-5.0"))
          .when(k % 67 == 0, F.lit("999999"))
          .when(k % 61 == 0, F.lit("5d")).when(k % 59 == 0, F.lit("3F")).when(k % 53 == 0, F.lit("0x1p3"))
          .when(k % 47 == 0, F.lit("1_000")).when(k % 43 == 0, F.lit("+5"))
          .otherwise(F.round("o_totalprice").cast("string")))
    label = (F.when(k % 101 == 0, F.lit(" "))
             .when(k % 103 == 0, F.concat(F.lit(" "), p))
             .when((k % 7 == 0) & (p == "5-LOW"), F.lit("5-LWO"))
             .when(k % 107 == 0, F.lower(p))
             .otherwise(p))
    return o.select(k.alias("row_id"), f1.alias("f1"), label.alias("label"))


# ---- D2 / D3 -----------------------------------------------------------------------------

def rid_expr() -> F.Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in
                              ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
                       F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"))


def with_rid(li: DataFrame) -> DataFrame:
    return li.withColumn("rid", rid_expr())


def d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = load(spark, sf_dir, "lineitem")
    rid = rid_expr()
    q = F.col("l_quantity")
    e = F.when(F.substring(F.md5(rid), 1, 1) == "0", F.greatest(q - 1, F.lit(1.0))).otherwise(q)
    return li.select(rid.alias("rid"), *D2_FEATURES,
                     F.floor((e - 1) / 10).cast("int").alias("cls"))


def rule_predictions(d2df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """D3: three deterministic rule models in one pass (explode, not a union of three scans)."""
    q = F.col("l_quantity")
    preds = F.array(
        F.struct(F.lit("m_exact").alias("model"), F.floor((q - 1) / 10).cast("int").alias("prediction")),
        F.struct(F.lit("m_shift").alias("model"), F.least(F.floor(q / 10), F.lit(4)).cast("int").alias("prediction")),
        F.struct(F.lit("m_const").alias("model"), F.lit(0).alias("prediction")),
    )
    return d2df.select("rid", F.col("cls").alias("label"), *keep, F.inline(preds)) \
        .select("model", "rid", "label", "prediction", *keep)


def d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_predictions(d2(spark, sf_dir))


def lineitem_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its unique row id (the V1-like, no-signal labelled table)."""
    return with_rid(load(spark, sf_dir, "lineitem"))


# ---- rule-based scores on D2 (deterministic inputs for M23/M24/M28) ----------------------

# Class centres and spread of the softmax rule, linear attribution weights.
PROB_CENTRES = (5.5, 15.5, 25.5, 35.5, 45.5)
PROB_SPREAD = 5.0
LINEAR_WEIGHTS = {"l_quantity": 0.1, "l_discount": -20.0, "l_tax": 25.0}


def rule_probabilities(d2df: DataFrame) -> DataFrame:
    """(rid, probability array<double>) — a softmax over distances to the class centres."""
    q = F.col("l_quantity")
    raw = [F.exp(-F.pow((q - F.lit(c)) / PROB_SPREAD, 2)) for c in PROB_CENTRES]
    t = d2df.select(F.col("rid").alias("row_id"), *[r.alias(f"e{i}") for i, r in enumerate(raw)])
    tot = sum((F.col(f"e{i}") for i in range(1, len(raw))), F.col("e0"))  # left to right, as a fold
    return t.select("row_id", F.array(*[F.col(f"e{i}") / tot for i in range(len(raw))]).alias("probability"))


def linear_contributions(d2df: DataFrame) -> DataFrame:
    """(rid, contributions array<double>): exact Shapley values of a linear score,
    w_f * (x_f - mean_f). The means are one aggregate row."""
    feats = list(LINEAR_WEIGHTS)
    means = d2df.agg(*[F.avg(f).alias(f) for f in feats]).first()
    arr = F.array(*[F.lit(LINEAR_WEIGHTS[f]) * (F.col(f) - F.lit(means[f])) for f in feats])
    return d2df.select(F.col("rid").alias("row_id"), arr.alias("contributions"))
