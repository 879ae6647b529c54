"""Compare Spark queries with their DuckDB twin. ``python -m tests.parity [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
DATA = "/root/testdata"
TIMES: dict[str, float] = {}


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, _plain(v)) for k, v in value.items()))
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return df.columns, [tuple(r) for r in df.collect()]


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def compare(spark, con, entry, sf_dir):
    """(problem or None, number of rows)."""
    start = time.time()
    cols, got = spark_rows(entry.plan(spark, sf_dir))
    TIMES[entry.name] = time.time() - start
    if entry.sql is None:
        return None, len(got)
    names, want = duck_rows(con, entry.sql)
    if sorted(cols) != sorted(names):
        return f"columns {sorted(cols)} != {sorted(names)}", len(got)
    a, b = _rows(cols, got), _rows(names, want)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}", len(got)
    for x, y in zip(a, b):
        if x != y:
            return f"columns {sorted(cols)}\n   got      {x}\n   expected {y}", len(got)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            if type(u) is not type(v):
                return f"types differ: {u!r} {v!r} in {sorted(cols)}", len(got)
    return None, len(got)


def main(argv):
    import warnings

    warnings.filterwarnings("ignore")
    from granary.plans.catalog import QUERIES
    from granary.session import build_session

    sf = argv[0] if argv else "sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = build_session(
        "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(f"{DATA}/{sf}")
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem, n = compare(spark, con, QUERIES[name], f"{DATA}/{sf}")
        except Exception as exc:  # report and go on
            problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
        kind = "sql " if QUERIES[name].sql else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {name:36s} {n:7d} rows, spark {TIMES.get(name, -1):6.2f}s all {time.time() - start:6.2f}s", flush=True)
        if problem:
            bad += 1
            print("   ", problem, flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
