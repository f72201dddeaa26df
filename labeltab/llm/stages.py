"""Stages of the corpus pipeline. All but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, near_dup, piece_sampling, secret_scan, toxicity
from .shared import ROW_DIGEST, ROW_KEY, table, with_row_keys


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go, each by its own text. It learns from all labelled documents of its input."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.clean(docs, toxicity.train(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays (five-word shingles, similarity 0.8), the one with the
    smallest doc_id, and one of equal rows without words. Rows count one by one, whatever their id."""
    rows = with_row_keys(docs, "near-rows")
    links = near_dup.link_documents(rows.select(F.col(ROW_KEY).alias("doc_id"), "text"), ngram=5, num=80, den=100)
    order = F.struct(F.col("id").isNull(), "id", ROW_DIGEST, ROW_KEY)
    group = F.when(F.col("n_shingles") > 0, F.col("component_id").cast("string")).otherwise(F.col(ROW_DIGEST))
    kept = (links.select(F.col("doc_id").alias(ROW_KEY), "n_shingles", "component_id")
            .join(rows.select(ROW_KEY, ROW_DIGEST, F.col("doc_id").alias("id")), ROW_KEY)
            .groupBy(group.alias("group")).agg(F.min(order)[ROW_KEY].alias(ROW_KEY)).select(ROW_KEY))
    return rows.join(kept, ROW_KEY, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, each by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; no document goes."""
    return secret_scan.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every text, with piece ids."""
    return piece_sampling.sample(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_leaks),
          ("secrets", mask_secrets), ("encoding", encode)]
