"""Sources and sinks.

Scans use explicit schemas (no inference pass). File-level operators use the ``binaryFile``
source, which reads file contents only when the ``content`` column is selected; large files are
digested by byte ranges of the ``text`` source. Table
fingerprints are order-insensitive aggregates (``count`` and the sum of a 60-bit row
digest), so they are one distributed pass and never depend on file layout.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labeltab.functions import sha256


# ---- S01–S03 scans ---------------------------------------------------------------------------

def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None,
         header: bool = True) -> DataFrame:
    """Read a labelled table; a missing path raises FileNotFoundError. CSV is read with an
    explicit schema, header checked against it, malformed values to null (PERMISSIVE)."""
    try:
        r = spark.read
        if schema is not None:
            r = r.schema(schema)
        if fmt == "csv":
            return r.options(header=header, enforceSchema=False, mode="PERMISSIVE").csv(path)
        if fmt == "json":
            return r.json(path)
        return r.format(fmt).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise FileNotFoundError(path) from e
        raise


def shape(df: DataFrame, name: str) -> DataFrame:
    """S01 report: rows and columns."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).cast("bigint").alias("n_columns"))


def preview(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """First ``n`` rows by key (TakeOrdered: a bounded top-k per partition)."""
    return df.orderBy(key).limit(n)


def dimension_join(fact: DataFrame, dim: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """S02 lookup: a left join; the optimizer broadcasts the dimension by its size in bytes."""
    return fact.join(dim, on, "left")


# ---- S04–S06 manifests and fingerprints -----------------------------------------------------

def list_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, file_name, length, modificationTime) without reading contents."""
    bf = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return bf.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "length",
                     "modificationTime")


def manifest(spark: SparkSession, folder: str, expected: Sequence[str], glob: str = "*") -> DataFrame:
    """Expected file names marked found / missing (left anti join gives the missing)."""
    present = list_files(spark, folder, glob).select("file_name")
    exp = spark.createDataFrame([(e,) for e in expected], "file_name string")
    missing = exp.join(present, "file_name", "left_anti").withColumn("status", F.lit("missing"))
    found = exp.join(present, "file_name", "left_semi").withColumn("status", F.lit("found"))
    return found.unionByName(missing)


#: a file above this size is digested by ranges of this size, each read by a task of its own
RANGE = 1 << 27
#: names that Spark's line reader would decompress
PACKED = r"(?i)\.(gz|bz2|zst|zstd|snappy|lz4|deflate|passthrough)$"
BOM = b"\xef\xbb\xbf"


def file_digests(spark: SparkSession, folder: str, glob: str = "*", range_bytes: int = RANGE) -> DataFrame:
    """sha256 of every file. A file of up to ``range_bytes`` is one binary value; a larger one is read by ranges
    (``_digests_by_range``, when this is called). Larger files with a name of ``PACKED``, or all where libcrypto is
    missing, still go whole, up to 2 GB."""
    bf = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    large = list_files(spark, folder, glob).where(F.col("length") > range_bytes).collect() if sha256.available() else []
    if not large:
        return _whole_digests(bf)
    packed = [_literal(f.path) for f in large if re.search(PACKED, f.file_name)]
    out = _whole_digests(bf.where(F.col("length") <= range_bytes))  # the source itself skips the others by their length
    if packed:
        out = out.unionByName(_whole_digests(spark.read.format("binaryFile").load(packed)))
    ranged = _digests_by_range(spark, [f for f in large if not re.search(PACKED, f.file_name)], range_bytes)
    return out.unionByName(spark.createDataFrame(ranged, out.schema))


def _whole_digests(bf: DataFrame) -> DataFrame:
    return bf.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length", F.sha2("content", 256).alias("sha256"))


def _literal(path: str) -> str:
    """A path whose glob characters stand for themselves."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _digests_by_range(spark: SparkSession, files: Sequence[Row], range_bytes: int, head: bytes = b"") -> list[tuple[str, int, str]]:
    """(file_name, length, sha256) of files read as lines ending in ``\\n``, which Spark splits by byte ranges and whose bytes
    it leaves as they are. A sha256 takes the bytes in order, so the k-th job reads the k-th range of every file and goes
    on from the state that the job before has left. A task reads its range and the line that crosses its end.
    ``head``: bytes that the reader skips at the start of the file."""
    sc, apart = spark.sparkContext, spark.newSession()  # its settings cut the ranges whatever the number of cores
    apart.conf.set("spark.sql.files.maxPartitionBytes", range_bytes)
    apart.conf.set("spark.sql.files.minPartitionNum", 1)
    apart.conf.unset("spark.sql.files.maxPartitionNum")
    lines = {f.path: apart.read.format("text").option("lineSep", "\n").load(_literal(f.path))
             .select("_metadata.file_block_start", F.col("value").cast("binary")) for f in files}
    at = {f.path: (sha256.update(sha256.begin(), head), len(head)) for f in files}
    left, start = list(files), 0
    while left:
        parts = [lines[f.path].mapInArrow(_digest_range(*at[f.path], start, f.length), "state binary, n_read long").rdd for f in left]
        sizes = [p.getNumPartitions() for p in parts]
        if sizes != [-(-f.length // range_bytes) for f in left]:
            raise ValueError(f"{[f.path for f in left]}: cut into {sizes} ranges of {range_bytes} bytes")
        states = sc.runJob(sc.union(parts), list, [i + start // range_bytes for i in accumulate(sizes[:-1], initial=0)])
        at |= {f.path: (bytes(s.state), s.n_read) for f, s in zip(left, states, strict=True)}
        start += range_bytes
        left = [f for f in left if f.length > start]
    out = []
    for f in files:
        state, n = at[f.path]
        if n in (f.length, f.length + 1):  # the last line may have no end
            out.append((f.file_name, f.length, sha256.hexdigest(state)))
        elif not head and n + len(BOM) in (f.length, f.length + 1):  # the line reader skips this mark
            out += _digests_by_range(spark, [f], range_bytes, BOM)
        else:
            raise ValueError(f"{f.path}: {n} bytes read of {f.length}")
    return out


def _digest_range(state: bytes, n_read: int, start: int, length: int):
    """Takes the state on by the lines that begin in the range at ``start``; one row of the new state and the bytes so far."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, n = state, n_read
        for b in batches:
            if not b.num_rows:
                continue
            if pc.min_max(b.column(0)).as_py() != {"min": start, "max": start}:
                raise ValueError(f"lines of another range than the one at {start}")
            data = b"\n".join(b.column(1).to_pylist()) + b"\n"
            n += len(data)
            s = sha256.update(s, data[:-1] if n > length else data)
        yield pa.RecordBatch.from_arrays([pa.array([s], pa.binary()), pa.array([n], pa.int64())], names=["state", "n_read"])

    return run


def canonical_text(df: DataFrame) -> Column:
    """Engine-independent text of a row: doubles as decimal(38,9), the rest as text, each with its
    length in front, so that no two rows of different values share a text; nulls and NaN apart."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(F.isnan(c), F.lit("NaN")).otherwise(c.try_cast("decimal(38,9)").cast("string"))
        text = c.cast("string")
        parts.append(F.when(text.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.char_length(text).cast("string"), F.lit(":"), text)))
    return F.concat(*parts)


def row_digest(df: DataFrame) -> Column:
    """60-bit integer from the md5 of the canonical row text."""
    return F.conv(F.substring(F.md5(canonical_text(df)), 1, 15), 16, 10).cast("bigint")


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """(table_name, n_rows, digest): order-insensitive, one pass."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(row_digest(df).cast("decimal(20,0)")).alias("digest")) \
        .select(F.lit(name).alias("table_name"), "n_rows", "digest")


def change_audit(before: DataFrame, after: DataFrame, key: str = "table_name") -> DataFrame:
    """Full outer join of two digest tables -> same / changed / added / removed."""
    b = before.select(key, F.col("n_rows").alias("n_rows_before"), F.col("digest").alias("d_before"))
    a = after.select(key, F.col("n_rows").alias("n_rows_after"), F.col("digest").alias("d_after"))
    j = b.join(a, key, "full_outer")
    status = (F.when(F.col("d_before").isNull(), F.lit("added"))
              .when(F.col("d_after").isNull(), F.lit("removed"))
              .when((F.col("d_before") == F.col("d_after")) & (F.col("n_rows_before") == F.col("n_rows_after")), F.lit("same"))
              .otherwise(F.lit("changed")))
    return j.select(key, status.alias("status"), F.coalesce("n_rows_before", F.lit(0)).cast("bigint").alias("n_rows_before"),
                    F.coalesce("n_rows_after", F.lit(0)).cast("bigint").alias("n_rows_after"))


# ---- S07–S09 sinks ---------------------------------------------------------------------------

def write_by(df: DataFrame, column: str, values: Sequence[str], path: str) -> None:
    """One Parquet table partitioned by ``column``, whose values must all be given: a job for each of them, so that no task
    sorts its rows by the column (the sort of ``partitionBy`` holds a task's rows in memory or spills them)."""
    for v in values:
        df.where(F.col(column) == v).drop(column).write.mode("overwrite").parquet(os.path.join(path, f"{column}={v}"))


def write_split_table(split_df: DataFrame, dim: DataFrame, path: str) -> None:
    """One Parquet table partitioned by ``split`` plus the label dimension beside it."""
    write_by(split_df, "split", ("train", "test"), os.path.join(path, "rows"))
    dim.coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "labels"))


def read_split(spark: SparkSession, path: str, split: str, columns: Sequence[str]) -> DataFrame:
    """Reload one split in a fixed column order (partition pruning on ``split``)."""
    return spark.read.parquet(os.path.join(path, "rows")).where(F.col("split") == split).select(*columns)


def round_report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Numeric report columns rounded (half-even), chosen from the schema."""
    return df.select(*[F.bround(F.col(f"`{f.name}`"), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """A small report table written as JSON lines or CSV with a header."""
    w = df.coalesce(1).write.mode("overwrite")
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.json(path)


# ---- S10 nested JSON -------------------------------------------------------------------------

def json_entries(df: DataFrame, key: str, column: str, value_type: str = "bigint") -> DataFrame:
    """A JSON-object text column as (key, entry, value) rows."""
    m = F.from_json(F.col(column), f"map<string,{value_type}>")
    return df.select(key, F.explode(m).alias("entry", "value"))


def json_leaves(df: DataFrame, key: str, column: str, max_depth: int = 64) -> DataFrame:
    """S10 without a schema: (key, path, kind, value) for every leaf of a JSON text, objects and arrays walked down as variants.
    Paths read ``$.a.b[0]``; ``kind`` is number, string, boolean or null, and object or array for empty ones. Text that is no
    JSON has one row with kind ``malformed``; a null text has none. Values nested deeper than ``max_depth`` raise."""
    spark = df.sparkSession
    kind = F.expr("CASE WHEN is_variant_null(v) THEN 'null' WHEN schema_of_variant(v) = 'STRING' THEN 'string' "
                  "WHEN schema_of_variant(v) = 'BOOLEAN' THEN 'boolean' WHEN schema_of_variant(v) LIKE 'OBJECT%' THEN 'object' "
                  "WHEN schema_of_variant(v) LIKE 'ARRAY%' THEN 'array' ELSE 'number' END")
    text = F.expr("variant_get(v, '$', 'string')")
    level = (df.where(F.col(column).isNotNull())
             .select(key, F.lit("$").alias("path"), F.col(column).alias("raw"), F.try_parse_json(column).alias("v"))
             .select(key, "path", F.when(F.col("v").isNull(), F.lit("malformed")).otherwise(kind).alias("kind"),
                     F.when(F.col("v").isNull(), F.col("raw")).otherwise(text).alias("value"), "v"))
    for _ in range(max_depth):
        # every row goes on in one plan: a leaf as it is, an object or array by its parts, so no level is worked out twice
        nested = F.col("kind").isin("object", "array") & ~F.col("value").isin("{}", "[]")
        if not level.where(nested).limit(1).count():
            return level.select(key, "path", "kind", "value")
        held = level.select(key, "path", "kind", "value", nested.alias("nested"), F.when(nested, F.col("v")).alias("outer"))
        parts = held.lateralJoin(spark.tvf.variant_explode_outer(F.col("outer").outer()).toDF("pos", "name", "v"))
        step = F.when(F.col("name").isNotNull(), F.concat(F.lit("."), "name")).otherwise(F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        level = parts.select(key, F.when(F.col("nested"), F.concat("path", step)).otherwise(F.col("path")).alias("path"),
                             F.when(F.col("nested"), kind).otherwise(F.col("kind")).alias("kind"),
                             F.when(F.col("nested"), text).otherwise(F.col("value")).alias("value"), "v")
    raise ValueError(f"{column}: values are nested deeper than {max_depth}")


def audit_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """S06 by path: two tables of ``file_digests`` -> (file_name, status, sha256_before, sha256_after)."""
    b = before.select("file_name", F.col("sha256").alias("sha256_before"))
    a = after.select("file_name", F.col("sha256").alias("sha256_after"))
    status = (F.when(F.col("sha256_before").isNull(), F.lit("added")).when(F.col("sha256_after").isNull(), F.lit("removed"))
              .when(F.col("sha256_before") == F.col("sha256_after"), F.lit("same")).otherwise(F.lit("changed")))
    return b.join(a, "file_name", "full_outer").select("file_name", status.alias("status"), "sha256_before", "sha256_after")
