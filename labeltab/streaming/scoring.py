"""Streaming validated scoring (M30), re-aimed from the interactive form.

``readStream`` over a folder of incoming rows -> row validation (stateless projection, so no
watermark or state store) -> ``foreachBatch``: score the valid rows with the fitted pipeline
and write them to ``scored``, write the rest with their messages to ``rejected``. Each batch
writes into its own ``batch_id=<n>`` folder with overwrite, so a replay after a failure
rewrites the same output (idempotent); progress lives in the checkpoint location.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.operators.contract import validate_rows
from labeltab.operators.models import Model, predict
from labeltab.spec import TableSpec


#: rows in one file of a stream's source folder: a micro-batch is read by a task for each of its files
ROWS_PER_FILE = 1 << 18


def score_batch(batch: DataFrame, model: Model, spec: TableSpec, name: str) -> tuple[DataFrame, DataFrame]:
    """Validated scoring of one batch (also the batch job M26): (scored, rejected). Rows need no label;
    a scored row has its class name, confidence and the classes ranked by probability."""
    v = validate_rows(batch, spec)
    good = v.where("is_valid").withColumns({f: F.col(f).cast("double") for f in spec.features})
    names = F.array(*[F.lit(str(c)) for c in sorted(spec.expected_classes)])
    ranked = F.sort_array(F.zip_with("probability", names, lambda p, c: F.struct((-p).alias("neg"), c.alias("class"))))
    scored = predict(model, good, spec, name).select(
        spec.key, "prediction", F.element_at(names, F.col("prediction") + 1).alias("predicted_label"),
        F.array_max("probability").alias("confidence"),
        F.transform(ranked, lambda r: F.struct(r["class"].alias("class"), (-r["neg"]).alias("probability"))).alias("probabilities"))
    rejected = v.where(~F.col("is_valid")).select(spec.key, "n_errors", F.array_join("errors", "; ").alias("errors"))
    return scored, rejected


def run_stream(spark: SparkSession, source_dir: str, schema: T.StructType, model: Model,
               spec: TableSpec, name: str, out_dir: str, checkpoint: str, max_files_per_trigger: int = 1) -> None:
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source_dir)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            scored, rejected = score_batch(batch, model, spec, name)
            scored.write.mode("overwrite").parquet(os.path.join(out_dir, "scored", f"batch_id={batch_id}"))
            rejected.write.mode("overwrite").parquet(os.path.join(out_dir, "rejected", f"batch_id={batch_id}"))
        finally:
            batch.unpersist()

    q = (stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_results(spark: SparkSession, out_dir: str, key: str) -> DataFrame:
    """Scored and rejected rows as one table: (key, is_valid, prediction, confidence, errors)."""
    scored = spark.read.parquet(os.path.join(out_dir, "scored")).select(
        key, F.lit(True).alias("is_valid"), "prediction", "confidence", F.lit(None).cast("string").alias("errors"))
    rejected = spark.read.parquet(os.path.join(out_dir, "rejected")).select(
        key, F.lit(False).alias("is_valid"), F.lit(None).cast("int").alias("prediction"),
        F.lit(None).cast("double").alias("confidence"), "errors")
    return scored.unionByName(rejected)
