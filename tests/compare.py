"""Run registered queries next to their SQL in DuckDB and compare the values.

``python -m tests.compare /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
import traceback

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return int(v) if v == v.to_integral_value() else float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
         "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def check(spark, con, sf, name, queries, oracles):
    """None when equal, else a description of the difference."""
    df = queries[name](spark, sf)
    rows = [tuple(plain(v) for v in r) for r in df.collect()]
    if name not in oracles:
        return f"rows only: {len(rows)}" if not rows else None
    rel = con.execute(oracles[name])
    cols = [d[0] for d in rel.description]
    want = [tuple(plain(v) for v in r) for r in rel.fetchall()]
    if sorted(cols) != sorted(df.columns):
        return f"columns {df.columns} != {cols}"
    types = dict(zip(cols, [str(d[1]) for d in rel.description]))
    odd = {f.name: (f.dataType.simpleString(), types[f.name]) for f in df.schema
           if KINDS.get(f.dataType.simpleString(), types[f.name]) != types[f.name]}
    order = [cols.index(c) for c in df.columns]
    key = lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r)
    a = sorted(rows, key=lambda r: str(r))
    b = sorted([tuple(r[i] for i in order) for r in want], key=lambda r: str(r))
    if len(a) != len(b):
        return f"{len(a)} rows != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first {bad[0]}"
    if odd:
        return f"types {odd}"
    return None


def main():
    from __spark_entry__ import oracle_sql, queries
    from clickloom.storage import release

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con, q, o = session(), duck(sf), queries(), oracle_sql()
    failed = 0
    for name in names or q:
        t = time.time()
        try:
            problem = check(spark, con, sf, name, q, o)
        except Exception as e:  # noqa: BLE001
            problem = "".join(traceback.format_exception_only(e))[:700]
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:26s} {time.time() - t:6.2f}s {'sql' if name in o else 'rows'} {problem or ''}", flush=True)
    release(spark)
    print("failed:", failed)


if __name__ == "__main__":
    main()
