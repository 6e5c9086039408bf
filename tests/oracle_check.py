"""Run registered queries beside their SQL and compare columns, types, row counts and values.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
_KINDS = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def digest(rows: list[tuple]) -> str:
    lines = sorted(repr(row) for row in rows)
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def compare(df, con, sql: str) -> tuple[str, int]:
    """("ok" or what differs, number of rows)."""
    columns = sorted(df.columns)
    rows = [tuple(row) for row in df.select(*[f"`{c}`" for c in columns]).collect()]
    shown = con.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {name: kind for name, kind, *_ in shown}
    ours = {name: _KINDS.get(kind, kind) for name, kind in df.dtypes}
    if ours != theirs:
        return f"schema {ours} against {theirs}", len(rows)
    listed = ", ".join(f'"{c}"' for c in columns)
    expected = con.execute(f"SELECT {listed} FROM ({sql})").fetchall()
    if len(rows) != len(expected):
        return f"{len(rows)} rows against {len(expected)}", len(rows)
    if digest(rows) != digest(expected):
        odd = sorted(set(map(repr, rows)) ^ set(map(repr, expected)))
        return f"values differ in {len(odd)} rows, such as {odd[:4]}", len(rows)
    return "ok", len(rows)


def main() -> int:
    from tests.spark_session import local_session

    import __spark_entry__ as driver

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:] or list(driver.queries())
    spark, con = local_session(), connect(sf_dir)
    queries, oracles = driver.queries(), driver.oracle_sql()
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                verdict, count = compare(df, con, oracles[name])
            else:
                verdict, count = "ok (rows only)", len(df.collect())
        except Exception as error:  # report and go on with the other queries
            verdict, count = f"{type(error).__name__}: {str(error)[:600]}", 0
        failed += not verdict.startswith("ok")
        print(f"{name:34s} {time.time() - start:6.2f}s {count:8d} rows  {verdict}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
