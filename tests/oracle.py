"""Compare queries with their SQL: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pyarrow as pa


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (list, tuple)):
        return [canon(x) for x in v]
    if isinstance(v, dict):
        return {k: canon(x) for k, x in v.items()}
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v


def rows(t: pa.Table) -> list[str]:
    names = sorted(t.column_names)
    return sorted(repr([canon(r[n]) for n in names]) for r in t.to_pylist())


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in os.listdir(directory):
        if f.endswith(".parquet"):
            path = f"{directory}/{f}"
            path = path + "/*.parquet" if os.path.isdir(path) else path
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def compare(spark, directory: str, query, sql: str) -> str:
    """Empty if the results agree, else what differs."""
    got, want = query(spark, directory).toArrow(), connect(directory).sql(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    a, b = rows(got), rows(want)
    if a != b:
        x, y = set(a), set(b)
        return f"{len(a)} and {len(b)} rows; only here {sorted(x - y)[:3]}; only in SQL {sorted(y - x)[:3]}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as e
    from lemmata.plans.runtime import session

    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or q:
        t = time.time()
        try:
            if name in o:
                why = compare(spark, sys.argv[1], q[name], o[name])
            else:
                why = "" if (n := q[name](spark, sys.argv[1]).count()) else "no rows"
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why)
        print(f"{'BAD' if why else 'ok '} {name} {time.time() - t:.1f}s {'' if name in o else '(rows only)'} {why[:900]}", flush=True)
    print("bad:", bad)
