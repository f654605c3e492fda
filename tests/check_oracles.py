"""Compare catalog queries with their SQL: python tests/check_oracles.py DIR [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as E  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(None if r[i] is None else r[i] for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    start = time.time()
    df = E.queries()[name](spark, sf_dir)
    ours = df.collect()
    took = time.time() - start
    start = time.time()
    cur = con.execute(E.oracle_sql()[name])
    theirs = cur.fetchall()
    columns = [d[0] for d in cur.description]
    a, b = sorted_rows(df.columns, ours), sorted_rows(columns, theirs)
    note = f"{len(ours)} rows, spark {took:.1f}s, sql {time.time() - start:.1f}s"
    if a[0] != b[0]:
        return False, f"columns {a[0]} != {b[0]}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    if len(a[1]) != len(b[1]) or bad:
        return False, f"{note}; {len(b[1])} in sql, {len(bad)} differ, first {bad[:1]}"
    return True, f"{note}; {len(columns)} columns"


if __name__ == "__main__":
    from conftest import make_session

    sf = sys.argv[1]
    session, con = make_session(), connect(sf)
    for q in sys.argv[2:] or list(E.queries()):
        if q in E.oracle_sql():
            try:
                ok, note = compare(session, con, q, sf)
            except Exception as e:  # report and go on with the next query
                ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
            print("ok  " if ok else "FAIL", q, note, flush=True)
        else:
            start = time.time()
            try:
                print("rows", q, E.queries()[q](session, sf).count(), f"{time.time() - start:.1f}s", flush=True)
            except Exception as e:
                print("FAIL", q, str(e)[:1500], flush=True)
