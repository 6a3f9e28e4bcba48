"""Compare every registered query with its SQL oracle on one scale; used by the tests and by hand: python tests/oracle_check.py [names]."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | str):
        return x
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10] if not hasattr(x, "hour") or (x.hour, x.minute, x.second) == (0, 0, 0) else x.isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    try:
        return float(x)
    except (TypeError, ValueError):
        return str(x)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return abs(a - b) <= 2e-6 * max(1, abs(a), abs(b))
    if isinstance(a, tuple) and isinstance(b, tuple):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b, strict=True))
    return a == b


def compare(spark, con, name, f, sql) -> str:
    """'' if equal, else what differs."""
    df = f(spark, SF)
    got = df.collect()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} {len(b)}"
    if not a:
        return "both empty"
    off = [(x, y) for x, y in zip(a, b, strict=True) if not all(same(p, q) for p, q in zip(x, y, strict=True))]
    return f"{len(off)} of {len(a)} differ: {off[0]}" if off else ""


if __name__ == "__main__":
    import tempfile
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    q, o = e.queries(), e.oracle_sql()
    con, bad = duck(), 0
    for n in sys.argv[1:] or q:
        t = time.time()
        try:
            why = compare(spark, con, n, q[n], o[n]) if n in o else ("" if q[n](spark, SF).count() else "no rows")
        except Exception as x:  # noqa: BLE001
            why = f"{type(x).__name__}: {str(x)[:600]}"
        bad += bool(why)
        print(f"{n}: {why or 'ok'} {'' if n in o else '(rows only) '}{time.time() - t:.1f}s", flush=True)
    print("bad", bad)
