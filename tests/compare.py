"""Runs registered queries on Spark and their SQL on DuckDB and compares the results exactly.

    python tests/compare.py [name ...]      names or prefixes; none = all
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads=8; SET memory_limit='12GB'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        return "~" if math.isnan(value) else repr(value + 0.0)
    if hasattr(value, "item"):
        return cell(value.item())
    return str(value)


def canon(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(map(cell, row)) for row in frame[names].itertuples(index=False, name=None))


def compare(spark, con, query, folder):
    start = time.time()
    left = query.run(spark, folder).toPandas()
    t_spark = time.time() - start
    if query.sql is None:
        return "rows-only", len(left), t_spark, 0.0, ""
    start = time.time()
    stop = threading.Timer(float(os.environ.get('SQL_LIMIT', '60')), con.interrupt)
    stop.start()
    try:
        right = con.execute(query.sql).df()
    finally:
        stop.cancel()
    t_duck = time.time() - start
    ln, lv = canon(left)
    rn, rv = canon(right)
    if ln != rn:
        return "COLUMNS", len(left), t_spark, t_duck, f"{ln} != {rn}"
    kinds = {n: (left[n].dtype.kind, right[n].dtype.kind) for n in ln if left[n].dtype.kind != right[n].dtype.kind}
    if lv == rv:
        return ("same" if not kinds else "same*"), len(left), t_spark, t_duck, f"{kinds}" if kinds else ""
    a, b = set(lv) - set(rv), set(rv) - set(lv)
    note = f"{len(lv)} vs {len(rv)} rows; only spark {len(a)} {sorted(a)[:2]}; only sql {len(b)} {sorted(b)[:2]} kinds {kinds}"
    return "DIFF", len(left), t_spark, t_duck, note


def main():
    from __spark_entry__ import load_queries
    from quireflow.session import local_session

    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    con = connect(folder)
    wanted = sys.argv[1:]
    bad = 0
    total = time.time()
    for name, q in load_queries().items():
        if wanted and not any(name == w or name.startswith(w.rstrip("*")) and w.endswith("*") or w in q.covers for w in wanted):
            continue
        try:
            verdict, n, ts, td, note = compare(spark, con, q, folder)
        except Exception as exc:  # report and go on
            verdict, n, ts, td, note = "ERROR", 0, 0, 0, f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += verdict in ("DIFF", "ERROR", "COLUMNS")
        empty = " EMPTY" if n == 0 else ""
        print(f"{verdict:9} {name:34} {n:8} rows spark {ts:5.1f}s sql {td:5.1f}s{empty} {note[:900]}", flush=True)
    print(f"bad: {bad}, {time.time() - total:.0f} s")


if __name__ == "__main__":
    main()
