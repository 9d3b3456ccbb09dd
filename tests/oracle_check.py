"""Compare registered queries with their SQL: python tests/oracle_check.py [sf] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        if os.path.exists(f"{sf_dir}/{table}.parquet"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return (tuple(columns[i] for i in order),
            sorted(tuple(normal(r[i]) for i in order) for r in rows))


def compare(spark, con, sf_dir, name, query, sql):
    """None when equal, else a text that shows the difference."""
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None
    cur = con.execute(sql)
    theirs = rows_of([d[0] for d in cur.description], cur.fetchall())
    if mine == theirs:
        return None
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    left, right = set(mine[1]), set(theirs[1])
    return (f"rows {len(mine[1])} / {len(theirs[1])}; only spark {sorted(left - right)[:3]}; "
            f"only sql {sorted(right - left)[:3]}")


def main(argv):
    from crawlsight.session import build_session
    import __spark_entry__ as gate

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = build_session("check", "local[8]", **{
        "spark.sql.shuffle.partitions": 8, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    queries, oracles = gate.queries(), gate.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, queries[name], oracles.get(name))
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        kind = "sql " if name in oracles else "rows"
        print(f"{'OK ' if problem is None else 'BAD'} {kind} {time.time() - start:6.2f}s {name} {problem or ''}",
              flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
