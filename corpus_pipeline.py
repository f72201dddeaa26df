"""Corpus pipeline: the stages that turn ``documents`` into training text.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet
and read again as the ``docs`` of the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from labeltab.llm import stages
from labeltab.llm.shared import stage, table

STAGES = stages.STAGES

#: trained models and sampled segmentations have no SQL form; tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; the rows of the last stage."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
