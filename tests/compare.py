"""Compares every query with its SQL over a data directory: python tests/compare.py [DIR] [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def views(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(directory).glob("*.parquet")):
        con.execute(f"create view {p.stem} as from read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows(columns: list[str], found) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def difference(spark, con, query, sql: str, directory: str) -> str:
    """Empty if query and SQL agree, else what differs first."""
    df = query(spark, directory)
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, cur.fetchall())
    if len(a) != len(b):
        extra, missing = [x for x in a[:100000] if x not in set(b)][:2], [x for x in b[:100000] if x not in set(a)][:2]
        return f"{len(a)} rows and {len(b)}; only ours {str(extra)[:300]}; only SQL {str(missing)[:300]}"
    return next((f"{str(x)[:300]} and {str(y)[:300]}" for x, y in zip(a, b) if x != y), "")


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    directory, names = (sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"), sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, found, sqls, bad = views(directory), e.queries(), e.oracle_sql(), 0
    for name in names or found:
        t = time.time()
        try:
            what = difference(spark, con, found[name], sqls[name], directory) if name in sqls else f"no SQL, {found[name](spark, directory).count()} rows"
        except Exception as x:
            what = f"error {type(x).__name__}: {str(x)[:600]}"
        if name not in sqls and not what.startswith("error"):
            print(f"  .. {name} {what} {time.time() - t:.1f} s", flush=True)
        else:
            bad += bool(what)
            print(f"{'BAD ' if what else '  ok'} {name} {what} {time.time() - t:.1f} s", flush=True)
    print("bad", bad)
    sys.exit(bool(bad))
