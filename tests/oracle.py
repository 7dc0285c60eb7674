"""Compare queries with their DuckDB statements: ``python tests/oracle.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides hold the same columns and rows, else what differs."""
    theirs = con.execute(sql)
    names = [d[0] for d in theirs.description]
    theirs = theirs.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    theirs = _rows(names, theirs)
    if len(ours) != len(theirs):
        return f"{len(ours)} rows != {len(theirs)}"
    for a, b in zip(ours, theirs):
        if a != b:
            return f"{sorted(names)}: {a} != {b}"
    return None


def main(folder: str, *names: str) -> None:
    from conftest import build_session

    import __spark_entry__ as driver

    spark, con = build_session(), connect(folder)
    oracles = driver.oracle_sql()
    bad = 0
    for name, run in driver.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                found = difference(run(spark, folder), con, oracles[name])
            else:
                found = f"rows only: {len(run(spark, folder).collect())}"
        except Exception as error:  # report and go on
            found = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += found is not None and not found.startswith("rows only")
        print(f"{name:28s} {time.time() - start:6.2f}s {found or 'same'}", flush=True)
    print(f"{bad} differ")


if __name__ == "__main__":
    main(*(sys.argv[1:] or ["/root/testdata/sf0.01"]))
