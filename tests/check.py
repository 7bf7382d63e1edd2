"""Compare named queries with their SQL checks: python tests/check.py [folder] [name ...]."""

from __future__ import annotations

import os
import sys
import time
import traceback
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from curul.plans import CHECKS, QUERIES
from curul.session import local_session
from curul.sources.staging import BASE_TABLES


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(repr(r[i]) for i in order) for r in rows)


def compare(spark, connection, folder, name):
    started = time.time()
    df = QUERIES[name](spark, folder)
    columns, mine = rows_of(df.columns, df.collect())
    took = time.time() - started
    if name not in CHECKS:
        return True, f"{sum(mine.values())} rows, unchecked, {took:.1f}s"
    cursor = connection.execute(CHECKS[name])
    theirs_columns, theirs = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    note = f"{sum(mine.values())} rows, {took:.1f}s"
    if columns != theirs_columns:
        return False, f"{note}; columns {columns} / {theirs_columns}"
    if mine != theirs:
        extra, missing = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
        return False, f"{note} / {sum(theirs.values())}; only here {extra}; only there {missing}"
    return True, note


def main():
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    names = [n for n in QUERIES if not wanted or any(w in n for w in wanted)]
    spark = local_session()
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, connection, folder, name)
        except Exception as error:
            ok, note = False, "".join(traceback.format_exception_only(error))[:1500]
        bad += not ok
        print(("ok   " if ok else "FAIL ") + name + ": " + note, flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
