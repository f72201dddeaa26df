"""Run registered Spark queries next to their DuckDB oracle SQL and compare results.

Usage: ``python -m tests.oracle_harness [sf_dir] [name-prefix ...]``. Prints one line per
query: row counts, schema (column names) and value agreement, exact and with tolerance.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (pd.Timestamp,)):
        return str(v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = []
    for rec in pdf[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def close(a, b, tol=1e-6) -> bool:
    if isinstance(a, float) and isinstance(b, (float, int)) or isinstance(b, float) and isinstance(a, (float, int)):
        return abs(float(a) - float(b)) <= tol * max(1.0, abs(float(a)), abs(float(b)))
    return a == b


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                 "boolean": "BOOLEAN", "float": "FLOAT", "smallint": "SMALLINT", "tinyint": "TINYINT",
                 "date": "DATE", "timestamp_ntz": "TIMESTAMP"}


def type_mismatches(sdf, rel) -> list[str]:
    """Columns whose Spark type does not correspond to the oracle's DuckDB type."""
    st = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    dt = dict(zip(rel.columns, [str(t) for t in rel.types]))
    return [f"{c}: spark {st[c]} vs oracle {dt.get(c)}" for c in sorted(st) if c in dt and st[c] != dt[c]]


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> dict:
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    rel = con.sql(sql)
    types_bad = type_mismatches(sdf, rel)
    dk = rel.df()
    res = {"name": name, "spark_rows": len(sp), "oracle_rows": len(dk), "spark_sec": round(t1 - t0, 2)}
    res["columns_match"] = sorted(sp.columns) == sorted(dk.columns)
    if not res["columns_match"]:
        res["detail"] = f"spark={sorted(sp.columns)} oracle={sorted(dk.columns)}"
        res["exact"] = res["close"] = False
        return res
    res["types_match"] = not types_bad
    if types_bad:
        res["exact"] = res["close"] = False
        res["detail"] = "types: " + "; ".join(types_bad)
        return res
    a, b = rows_of(sp), rows_of(dk)
    res["exact"] = a == b
    res["close"] = len(a) == len(b) and all(all(close(x, y) for x, y in zip(ra, rb)) for ra, rb in zip(a, b))
    if not res["exact"]:
        for ra, rb in zip(a, b):
            if ra != rb:
                res["detail"] = f"cols={sorted(sp.columns)}\n   spark ={ra}\n   oracle={rb}"
                break
        else:
            res["detail"] = "row count differs"
    return res


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from labeltab.session import get_spark
    import __spark_entry__ as E

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    prefixes = argv[1:]
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        if name not in sqls:
            t0 = time.time()
            try:
                n = qs[name](spark, sf_dir).count()
                print(f"ROWS  {name}: {n} rows ({time.time() - t0:.1f}s)", flush=True)
            except Exception as e:  # noqa: BLE001
                bad += 1
                print(f"ERROR {name}: {type(e).__name__}: {str(e)[:400]}", flush=True)
            continue
        try:
            r = compare(spark, con, name, qs[name], sqls[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}", flush=True)
            continue
        tag = "OK   " if r["exact"] else ("CLOSE" if r["close"] else "FAIL ")
        if not r["exact"]:
            bad += 1
        print(f"{tag} {name}: rows {r['spark_rows']}/{r['oracle_rows']} ({r['spark_sec']}s)"
              + (f"\n   {r.get('detail', '')}" if not r["exact"] else ""), flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
