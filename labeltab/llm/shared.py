"""Tables between the jobs of an operator, and a row prefilter of fixed size.

``stage`` writes a DataFrame to Parquet in the shared folder (``spark.checkpoint.dir``) and reads
it back: lineage is cut there, so a lost executor costs only the tasks of the current job.
"""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labeltab.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver's working directory is elsewhere."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder, return the written table."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: slots of the id bitmap: 2^22 bits, 65,536 rows of 64 bits (1 MB) whatever the data size
ID_BITS = 1 << 22


def only_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` that may have a key in ``ids`` (a superset of the semi-join).

    A bitmap with a fixed number of bits is broadcast, so its size does not grow with the data;
    a full bitmap only lets more rows through. The exact join follows at the caller.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(ID_BITS))
    bits = (ids.where(F.col(key).isNotNull()).select(slot.alias("s"))
            .groupBy(F.shiftright("s", 6).alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, CAST(s & 63 AS INT))")).alias("_bits")))
    probe = df.withColumn("_slot", slot)
    hit = F.expr("_bits & shiftleft(1L, CAST(_slot & 63 AS INT))") != 0
    return (probe.join(F.broadcast(bits), (F.shiftright("_slot", 6) == F.col("_word")) & hit, "left_semi")
            .drop("_slot"))


def without_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key is not in ``ids``; rows with a null key stay. Columns stay as they are."""
    return df.join(ids.select(key).distinct(), key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])


ROW_KEY, ROW_DIGEST = "__row_key", "__row_digest"


def with_row_keys(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table with a key of its own on every row, equal rows and rows without an
    id included, and a digest that is the same for equal rows only. The key holds for this table."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return stage(df.withColumn(ROW_DIGEST, F.sha2(text, 256)).withColumn(ROW_KEY, F.monotonically_increasing_id()), name)


def bounded_sample(df: DataFrame, rows: int, key: str) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same rows on every run.

    For fits only. The bound is a parameter of the caller.
    """
    return stage(df.orderBy(F.xxhash64(key), key).limit(rows), "sample")
