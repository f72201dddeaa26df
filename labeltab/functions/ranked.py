"""Distinct values in order, with running counts over all rows of a feature.

Distinct (feature, value, label) counts are sorted once into range partitions and written with their partition
number. A partition's own running counts and the totals of the partitions before it (one row per partition
and feature) give every value its rank, with no join over ranges and no window over a whole feature.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labeltab.session import scratch_path

#: distinct (feature, value, label) rows in one range partition
ROWS_PER_PART = 1 << 18


@dataclass
class Ranked:
    rows: DataFrame  # feature, value, label, n, pid
    parts: DataFrame  # feature, pid, first (smallest value), before (rows of the feature in earlier partitions)


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(values: DataFrame, rows_per_part: int = ROWS_PER_PART) -> Ranked:
    """From ``(feature, value, label)`` rows without nulls; equal values of a feature share a partition."""
    counts = _written(values.groupBy("feature", "value", "label").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    parts = max(1, -(-counts.count() // rows_per_part))
    dealt = counts.repartitionByRange(parts, "feature", "value").sortWithinPartitions("feature", "value")
    rows = _written(dealt.withColumn("pid", F.spark_partition_id()), "ranked-values")
    before = Window.partitionBy("feature").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = (rows.groupBy("feature", "pid").agg(F.sum("n").alias("c"), F.min("value").alias("first"))
              .select("feature", "pid", "first", F.coalesce(F.sum("c").over(before), F.lit(0)).cast("bigint").alias("before")))
    return Ranked(rows, _written(totals, "ranked-parts"))


def running(r: Ranked) -> DataFrame:
    """The rows with ``upto`` and ``below``: how many rows of the feature are at most, and less than, the value."""
    own = Window.partitionBy("feature", "pid").orderBy("value")
    peers = own.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    at = Window.partitionBy("feature", "pid", "value")
    return (r.rows.withColumn("upto", F.sum("n").over(peers)).withColumn("here", F.sum("n").over(at))
            .join(r.parts.select("feature", "pid", "before"), ["feature", "pid"])
            .select("feature", "value", "label", "n", (F.col("before") + F.col("upto")).alias("upto"),
                    (F.col("before") + F.col("upto") - F.col("here")).alias("below")))
