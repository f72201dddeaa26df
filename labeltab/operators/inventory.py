"""A14 column inventory from mergeable summaries, and row digests for whole-row duplicates.

The table is scanned once. Spark turns every value into a 64-bit hash, or two for values longer than
8 bytes, and a code (missing, infinite, invalid); a task reduces its Arrow batches to the distinct hashes of
each column and one row of counts. Only those are shuffled, by (column, hash), so neither the rows
nor a copy of them for each column move, and a frequent value is one row a task.

The 64-bit hash is one-to-one on values of up to 8 bytes, so their distinct counts are exact. Longer values
(texts, wide decimals, binary, nested values as JSON) count by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.functions.exprs import is_blank, is_floating, is_missing, is_numeric, strict_number

STATE = "position int, h1 long, h2 long, n long, missing long, infinite long, invalid long"
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_MISSING, _INFINITE, _INVALID = 1, 2, 4


def _wide(dt: T.DataType) -> bool:
    if isinstance(dt, T.DecimalType):
        return dt.precision > 18
    return not (is_numeric(dt) or isinstance(dt, (T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)))


def row_keys(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Grouping keys under which two rows are equal if all ``columns`` are (null and NaN equal themselves): 192 bits
    of hashes of the plain columns, each with its null flag, and nested columns as they are. A group-by on them ships
    24 bytes a distinct row, whatever the width of the table."""
    plain = [c for c in columns if not isinstance(df.schema[c].dataType, _NESTED)]
    parts = [x for c in plain for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    hashes = [F.xxhash64(F.lit(seed), *parts).alias(f"__k{seed}") for seed in (1, 2, 3)] if plain else []
    return hashes + [F.col(f"`{c}`") for c in columns if c not in plain]


def _coded(df: DataFrame, c: str, parsed: bool) -> tuple[Column, Column]:
    """(value, code) of a column; the value is null where it is missing or invalid."""
    dt, col = df.schema[c].dataType, F.col(f"`{c}`")
    missing, invalid, value = is_missing(col, dt), F.lit(False), col
    if isinstance(dt, _NESTED):  # a hash of the value itself would skip nulls inside
        value = F.to_json(F.struct(col), {"ignoreNullFields": "false"})
    if parsed:
        value = strict_number(col)
        missing = col.isNull() | is_blank(col) | F.coalesce(F.isnan(value), F.lit(False))
        invalid = value.isNull()
    infinite = value.isin(float("inf"), float("-inf")) if parsed or is_floating(dt) else F.lit(False)
    code = F.when(missing, _MISSING).when(invalid, _INVALID).when(infinite, _INFINITE).otherwise(0)
    return F.when(~missing & ~invalid, value), code


def column_states(df: DataFrame, columns: Sequence[str], parsed: Sequence[str] = (), held: int = 1 << 20) -> DataFrame:
    """``STATE`` rows: the distinct value hashes of each task and column (h1 set) and its counts (h1 null). A task keeps
    up to about ``held`` hashes before it sends them on, which bounds its memory and changes no result."""
    m, exprs, wide = len(columns), [], []
    for i, c in enumerate(columns):
        value, code = _coded(df, c, c in parsed)
        wide.append(c not in parsed and _wide(df.schema[c].dataType))
        exprs += [code.cast("tinyint").alias(f"f{i}"), F.when(value.isNotNull(), F.xxhash64(value)).alias(f"k{i}")]
        if wide[i]:
            exprs.append(F.when(value.isNotNull(), F.xxhash64(F.lit(1), value)).alias(f"g{i}"))

    def distinct(parts: list[np.ndarray]) -> np.ndarray:
        x = np.concatenate(parts)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        return x[np.append(True, (x[1:] != x[:-1]).any(axis=1))] if len(x) else x

    def send(position: int, keys: np.ndarray) -> pa.RecordBatch:
        none = pa.array(np.zeros(len(keys), np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), position, np.int32)), pa.array(np.ascontiguousarray(keys[:, 0])),
                                           pa.array(np.ascontiguousarray(keys[:, 1])), none, none, none, none], names=names)

    names = [x.split()[0] for x in STATE.split(", ")]

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, seen, size = np.zeros((m, 4), np.int64), [[np.zeros((0, 2), np.int64)] for _ in range(m)], 0
        for batch in batches:
            for i in range(m):
                code = batch.column(f"f{i}").to_numpy(zero_copy_only=False)
                counts[i] += [len(code), (code == 1).sum(), (code == 2).sum(), (code == 4).sum()]
                keys = np.zeros((batch.num_rows - batch.column(f"k{i}").null_count, 2), np.int64)
                keys[:, 0] = batch.column(f"k{i}").drop_null().to_numpy()
                if wide[i]:
                    keys[:, 1] = batch.column(f"g{i}").drop_null().to_numpy()
                seen[i].append(distinct([keys]))
                size += len(seen[i][-1])
            if size > held:
                seen = [[distinct(x)] for x in seen]
                size = sum(len(x[0]) for x in seen)
                if size > held // 2:
                    yield from (send(i, x[0]) for i, x in enumerate(seen))
                    seen, size = [[np.zeros((0, 2), np.int64)] for _ in range(m)], 0
        yield from (send(i, distinct(x)) for i, x in enumerate(seen))
        no_key = pa.nulls(m, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m, dtype=np.int32)), no_key, no_key,
                                          *[pa.array(np.ascontiguousarray(counts[:, j])) for j in range(4)]], names=names)

    return df.select(*exprs).mapInArrow(reduce, STATE)


def column_inventory(df: DataFrame, columns: Sequence[str] | None = None, parsed: Sequence[str] = (), held: int = 1 << 20) -> DataFrame:
    """Dtype, kind, missing, missing %, distinct, infinite, invalid numbers, constant; one row a column, also for an
    empty table.

    Text columns named in ``parsed`` are read as numbers: blanks and NaN are missing, text that is no number is
    invalid, and distinct values are those of the numbers.
    """
    cols = list(columns or df.columns)
    none = df.sparkSession.createDataFrame([(i, None, None, 0, 0, 0, 0) for i in range(len(cols))], STATE)
    totals = [F.sum(x).alias(x) for x in ("n", "missing", "infinite", "invalid")]
    merged = (column_states(df, cols, parsed, held).unionByName(none).groupBy("position", "h1", "h2").agg(*totals)
              .groupBy("position").agg(F.count("h1").alias("u"), *totals))
    facts = []
    for c in cols:
        dt = df.schema[c].dataType
        kind = "numeric" if c in parsed or is_numeric(dt) else ("categorical" if isinstance(dt, T.StringType) else "other")
        facts.append(F.struct(F.lit(c).alias("c"), F.lit(dt.simpleString()).alias("t"), F.lit(kind).alias("k")))
    fact = F.array(*facts)[F.col("position")]
    return merged.select(
        "position", fact["c"].alias("column_name"), fact["t"].alias("data_type"), fact["k"].alias("feature_type"),
        F.col("missing").alias("missing_values"), F.try_divide(F.col("missing") * 100.0, F.col("n")).alias("missing_pct"),
        F.col("u").alias("unique_values"), F.col("infinite").alias("infinite_values"),
        F.col("invalid").alias("invalid_numeric_values"), (F.col("u") <= 1).alias("constant_column")).orderBy("position")
