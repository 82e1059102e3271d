"""Runs registered queries next to their SQL in DuckDB and compares rows, types and values.

``python tests/compare.py [--sf sf0.01] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("BALLGRAPH_TESTDATA", "/root/testdata")

SPARK_TO_SQL = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
                "boolean": "BOOLEAN"}


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return value


def _bag(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def oracle(folder: str, sql: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    return types, con.execute(sql).fetchall()


def check(spark, name: str, folder: str) -> tuple[bool, str]:
    import __spark_entry__ as contract

    start = time.time()
    df = contract.queries()[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    spent = time.time() - start
    sql = contract.oracle_sql().get(name)
    if sql is None:
        return len(rows) > 0, f"rows={len(rows)} no SQL {spent:.1f}s"
    types, want = oracle(folder, sql)
    ours = {f.name: SPARK_TO_SQL.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    if ours != types:
        return False, f"schema {ours} != {types}"
    a, b = _bag(rows, list(df.columns)), _bag(want, list(types))
    if a != b:
        only_a, only_b = list((a - b).items()), list((b - a).items())
        return False, (f"rows {len(rows)}/{len(want)}; only ours {len(only_a)} {only_a[:3]}; "
                       f"only SQL {len(only_b)} {only_b[:3]}")
    return True, f"rows={len(rows)} {spent:.1f}s"


def main(args: list[str]) -> int:
    from tests.conftest import make_session
    import __spark_entry__ as contract

    sf = "sf0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        args = args[:at] + args[at + 2:]
    spark = make_session()
    failed = 0
    for name in args or contract.queries():
        try:
            ok, note = check(spark, name, f"{DATA}/{sf}")
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
