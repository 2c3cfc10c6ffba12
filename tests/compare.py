"""Run registered queries in Spark and their SQL in DuckDB and compare the rows.

Usage: python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
)


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


KINDS = {
    "bigint": "int", "int": "int", "smallint": "int", "tinyint": "int", "double": "float", "float": "float",
    "BIGINT": "int", "INTEGER": "int", "SMALLINT": "int", "TINYINT": "int", "DOUBLE": "float", "FLOAT": "float",
    "string": "text", "VARCHAR": "text", "boolean": "bool", "BOOLEAN": "bool",
}


def kind(t: str) -> str:
    return KINDS.get(t, t)


def compare(spark, con, name: str, fn, sql: str | None, sf: str) -> tuple[bool, str]:
    df = fn(spark, sf)
    names = sorted(df.columns)
    start = time.time()
    left = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    took = time.time() - start
    if sql is None:
        return True, f"{sum(left.values())} rows, no SQL, {took:.1f}s"
    start = time.time()
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    if sorted(cols) != names:
        return False, f"columns {names} != {sorted(cols)}"
    spark_types = dict(df.dtypes)
    odd = {c: (spark_types[c], types[c]) for c in names if kind(spark_types[c]) != kind(types[c])}
    at = [cols.index(c) for c in names]
    right = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    info = f"{sum(left.values())} vs {sum(right.values())} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s"
    if left != right:
        return False, (
            f"{info}\n  cols {names}\n  only spark {[str(x)[:600] for x in list((left - right))[:3]]}"
            f"\n  only sql {[str(x)[:600] for x in list((right - left))[:3]]}"
        )
    if odd:
        return False, f"{info} types {odd}"
    return True, info


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry_module

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    chosen = [n for n in queries if not args or any(a in n for a in args)]
    spark, con = session(), duck(sf)
    bad = []
    for n in chosen:
        try:
            ok, info = compare(spark, con, n, queries[n], oracles.get(n), sf)
        except Exception as e:  # noqa: BLE001
            ok, info = False, f"{type(e).__name__}: {str(e)[:900]}"
        if not ok:
            bad.append(n)
        print("ok  " if ok else "FAIL", n, info, flush=True)
    print(f"{len(chosen) - len(bad)}/{len(chosen)} ok; bad: {bad}")
