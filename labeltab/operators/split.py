"""Encoding, exact stratified split and folds.

Ordering inside a class is by a seeded digest ``md5(seed|key)``, so the result is
reproducible and engine-independent. The rank of a row inside its class is computed without
a class-wide window: rows are ranked inside (class, digest-prefix bucket) partitions and a
small per-bucket offset table (classes x buckets rows) is added back. A class holding a third
of all rows is therefore spread over ``16**prefix`` tasks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltab.functions.exprs import hash_order_key, is_missing
from labeltab.session import scratch_path
from labeltab.spec import TableSpec


def _labelled(df: DataFrame, spec: TableSpec) -> DataFrame:
    return df.where(~is_missing(spec.target, df.schema[spec.target].dataType))


# ---- C08–C09 label encoding -------------------------------------------------------------------

def label_dimension(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(label, code) with codes 0..k-1 in the order of the label's own type."""
    if spec.expected_classes:
        labels = sorted(spec.expected_classes)
        return df.sparkSession.createDataFrame([(str(c), i) for i, c in enumerate(labels)], "label string, code int")
    d = _labelled(df, spec).select(F.col(spec.target).alias("own")).distinct()
    return d.select(F.col("own").cast("string").alias("label"),
                    (F.dense_rank().over(Window.orderBy("own")) - 1).cast("int").alias("code"))  # k rows


def encode(df: DataFrame, spec: TableSpec, dim: DataFrame, out: str = "code") -> DataFrame:
    """Attach the class code by a join with the k-row dimension."""
    d = dim.select(F.col("label").alias("__l"), F.col("code").alias(out))
    return df.join(F.broadcast(d), F.col(spec.target).cast("string") == F.col("__l"), "left").drop("__l")  # k rows


def decode(df: DataFrame, dim: DataFrame, code: str = "code", out: str = "decoded") -> DataFrame:
    """Code -> label through the same dimension."""
    d = dim.select(F.col("code").alias("__c"), F.col("label").alias(out))
    return df.join(F.broadcast(d), F.col(code) == F.col("__c"), "left").drop("__c")  # k rows


# ---- class rank (shared by C10 and C12) --------------------------------------------------------

#: rows that one bucket of a rank sorts
ROWS_PER_BUCKET = 1 << 20
#: digest ranges that rows are counted by
RANGES = 16 ** 4


def class_rank(df: DataFrame, spec: TableSpec, salt: str = "", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``__h`` (digest) and ``rank_in_class`` (1-based, by digest) to every labelled row. Digests are cut into equal
    ranges, as many as the rows need for ``rows_per_bucket`` each; a rank is the number of rows in lower ranges plus the rank
    in the row's own. Only the columns that the caller goes on to use are moved; keys should be distinct."""
    if not spec.key:
        raise ValueError("a key column is required for a reproducible order")
    return _ranked(df, spec, salt, rows_per_bucket)[0]


def _ranked(df: DataFrame, spec: TableSpec, salt: str, rows_per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``class_rank``, and the counts (label, __b, __n) by ``RANGES`` digest ranges, from one scan."""
    t = (_labelled(df, spec).withColumn("__h", hash_order_key(f"{spec.seed}{salt}", spec.key))
         .withColumn("__b", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int")))
    counts = _kept(t.groupBy(spec.target, "__b").agg(F.count(F.lit(1)).alias("__n")), "rank-counts")
    rows = counts.agg(F.sum("__n")).first()[0] or 0
    buckets = min(RANGES, max(1, -(-rows // rows_per_bucket)))
    bucket = F.floor(F.col("__b") * F.lit(buckets) / RANGES).cast("int")
    local = t.withColumn("__b", bucket).withColumn("__r", F.row_number().over(Window.partitionBy(spec.target, "__b").orderBy("__h", spec.key)))
    w = Window.partitionBy(spec.target).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (counts.groupBy(spec.target, bucket.alias("__b")).agg(F.sum("__n").alias("__n"))
               .withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n"))  # classes x buckets
    ranked = (local.join(_kept(offsets, "rank-offsets"), [spec.target, "__b"])
              .withColumn("rank_in_class", F.col("__r") + F.col("__off"))
              .drop("__b", "__r", "__off"))
    return ranked, counts


def _kept(small: DataFrame, name: str) -> DataFrame:
    """A small table written once: later jobs do not work it out again, and its size is known to the joins."""
    path = scratch_path(small.sparkSession, name)
    small.write.parquet(path)
    return small.sparkSession.read.schema(small.schema).parquet(path)


# ---- C10–C11 exact stratified split ----------------------------------------------------------

def train_quotas(class_counts: dict, test_fraction: float) -> dict:
    """Per-class train quota: floor(n_c * n_train / n) plus one for the largest fractional
    parts (ties by class) until the quotas sum to n_train; n_test = ceil(f * n)."""
    n = sum(class_counts.values())
    n_test = math.ceil(test_fraction * n)
    n_train = n - n_test
    base = {c: (k * n_train) // n for c, k in class_counts.items()}
    rem = sorted(class_counts, key=lambda c: (-((class_counts[c] * n_train) % n), str(c)))
    left = n_train - sum(base.values())
    for c in rem[:left]:
        base[c] += 1
    return base


def quota_table(df: DataFrame, spec: TableSpec) -> DataFrame:
    """(label, quota) by the rule of ``train_quotas``, in the plan (k rows)."""
    return _quotas(_labelled(df, spec).groupBy(spec.target).agg(F.count(F.lit(1)).alias("n")), spec)


def _quotas(counts: DataFrame, spec: TableSpec) -> DataFrame:
    counts = counts.withColumn("n", F.col("n").cast("decimal(38,0)"))
    whole = Window.partitionBy()
    t = counts.withColumn("total", F.sum("n").over(whole).cast("decimal(38,0)"))
    t = t.withColumn("n_train", (F.col("total") - F.ceil(F.lit(spec.test_fraction) * F.col("total").cast("double"))).cast("decimal(38,0)"))
    t = t.withColumn("base", F.expr("cast(n * n_train as decimal(38,0)) div total")) \
         .withColumn("rest", F.expr("cast(n * n_train as decimal(38,0)) % total"))
    t = t.withColumn("left", F.col("n_train") - F.sum("base").over(whole)) \
         .withColumn("turn", F.row_number().over(Window.orderBy(F.desc("rest"), F.col(spec.target).cast("string"))))
    return t.select(spec.target, (F.col("base") + (F.col("turn") <= F.col("left")).cast("int")).cast("bigint").alias("quota"))


def stratified_split(df: DataFrame, spec: TableSpec, prefix: int = 4) -> DataFrame:
    """Adds ``split`` = train/test with exact per-class quotas. The quota-th digest of a class
    is found from counts per digest bucket and the rows of one bucket per class; a row's split is
    then a comparison with its class's cut-off. No row is shuffled for it."""
    if not spec.key:
        raise ValueError("a key column is required for a reproducible order")
    rows = _labelled(df, spec).withColumn("__h", hash_order_key(spec.seed, spec.key))
    small = rows.select(spec.target, "__h", F.col(spec.key).alias("__k"), F.substring("__h", 1, prefix).alias("__b"))
    before = Window.partitionBy(spec.target).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # counts only
    found = _kept(small.groupBy(spec.target, "__b").agg(F.count(F.lit(1)).alias("c")), "split-counts")
    quotas = _quotas(found.groupBy(spec.target).agg(F.sum("c").alias("n")), spec)
    counts = found.withColumn("cum", F.coalesce(F.sum("c").over(before), F.lit(0)))
    cut = (counts.join(quotas, spec.target)
           .where((F.col("cum") < F.col("quota")) & (F.col("quota") <= F.col("cum") + F.col("c")))
           .select(spec.target, "__b", (F.col("quota") - F.col("cum")).alias("need")))
    inside = Window.partitionBy(spec.target).orderBy("__h", "__k")  # rows of one bucket
    last = (small.join(_kept(cut, "split-buckets"), [spec.target, "__b"]).withColumn("r", F.row_number().over(inside)).where("r = need")
            .select(F.col(spec.target).alias("__label"), F.col("__h").alias("__cut"), F.col("__k").alias("__cut_key")))
    cuts = _kept(last, "split-cuts")  # k rows
    train = (F.col("__h") < F.col("__cut")) | ((F.col("__h") == F.col("__cut")) & (F.col(spec.key) <= F.col("__cut_key")))
    return (rows.join(cuts, F.col(spec.target) == F.col("__label"), "left")
            .withColumn("split", F.when(train, F.lit("train")).otherwise(F.lit("test")))
            .drop("__label", "__cut", "__cut_key", "__h"))


def split_report(split_df: DataFrame, spec: TableSpec) -> DataFrame:
    """C11: rows per (split, label)."""
    return split_df.groupBy("split", F.col(spec.target).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# ---- C12–C13 stratified k-fold -----------------------------------------------------------------

def stratified_folds(train: DataFrame, spec: TableSpec) -> DataFrame:
    """fold = (offset_c + rank_in_class - 1) mod k, i.e. rows sorted by (class, digest)
    and dealt round-robin — every fold gets floor or ceil of each class's share."""
    if not spec.key:
        raise ValueError("a key column is required for a reproducible order")
    ranked, found = _ranked(train, spec, "|fold", ROWS_PER_BUCKET)
    counts = found.groupBy(spec.target).agg(F.sum("__n").alias("__n"))
    w = Window.orderBy(spec.target).rowsBetween(Window.unboundedPreceding, -1)  # k rows
    off = counts.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    return (ranked.join(off, spec.target)  # k rows: the optimizer broadcasts it under its threshold
            .withColumn("fold", ((F.col("__off") + F.col("rank_in_class") - 1) % spec.n_folds).cast("int"))
            .drop("__off", "__h", "rank_in_class"))


def fold_sizes(folds: DataFrame) -> DataFrame:
    """Per fold (numbered from 1): training and validation sizes."""
    c = folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n_validation"))
    tot = F.sum("n_validation").over(Window.partitionBy())  # k_folds rows
    return c.select((F.col("fold") + 1).cast("int").alias("fold"), (tot - F.col("n_validation")).cast("bigint").alias("n_train"),
                    F.col("n_validation").cast("bigint"))


# ---- C14–C15 -----------------------------------------------------------------------------------

def union_splits(parts: Sequence[DataFrame]) -> DataFrame:
    """C14: concatenation by column name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ablation_sets(df: DataFrame, spec: TableSpec, key_feature: str | None = None) -> DataFrame:
    """Named feature subsets (all features, then each one left out) with the number of
    rows complete on that subset — one aggregate pass."""
    feats = list(spec.features)
    configs = [("A_All_Features", feats)]
    for i, f in enumerate(feats):
        configs.append((f"{chr(ord('B') + i)}_No_{f}", [g for g in feats if g != f]))
    aggs = []
    for j, (_, fs) in enumerate(configs):
        ok = F.lit(True)
        for f in fs:
            ok = ok & ~is_missing(f, df.schema[f].dataType)
        aggs.append(F.count_if(ok).alias(f"c{j}"))
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(name).alias("config"), F.lit(len(fs)).alias("n_features"),
                     F.lit(",".join(fs)).alias("features"), F.col(f"c{j}").cast("bigint").alias("n_complete_rows"))
            for j, (name, fs) in enumerate(configs)]
    return one.select(F.inline(F.array(*rows)))
