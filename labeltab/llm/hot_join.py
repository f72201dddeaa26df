"""Left join to a table with one row per key, where one key may hold a third of all rows.

A key is hot if it holds over 1/``SHARE`` of the rows; there are at most ``SHARE`` such keys at
any size of the data, so their table rows are broadcast. All other rows meet the table in a
shuffle join, in which no key has more than 1/``SHARE`` of the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

SHARE = 2000


def join_hot(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` with the other columns of ``table`` (null where the key is missing there).

    Null keys are equal to each other. ``rows`` is read three times: give a written table. The
    column names of both sides must differ but for the key.
    """
    cols = [c for c in table.columns if c != key]
    right = table.withColumnRenamed(key, "__key")
    sizes = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("n")).first()["n"]
    same = F.col(key).eqNullSafe(F.col("__key"))
    hot = stage(sizes.where(F.col("__n") * SHARE > total).select("__key"), "hot-keys")
    few = F.broadcast(hot.withColumnRenamed("__key", "__hot"))
    values = right.join(few, F.col("__key").eqNullSafe(F.col("__hot")), "left_semi")
    often = (rows.join(F.broadcast(hot), same, "left_semi")
             .join(F.broadcast(values), same, "left").select(*rows.columns, *cols))
    rest = rows.join(F.broadcast(hot), same, "left_anti").join(right, same, "left").select(*rows.columns, *cols)
    return often.unionByName(rest)
