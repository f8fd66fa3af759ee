"""Run queries against their SQL twins: python tests/oracle_check.py [sf] [name ...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    con.execute("SET TimeZone='UTC'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return 0.0 if v == 0 else float(repr(v))
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return float(v)
    except ImportError:
        pass
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark, con, sf_dir, name):
    fn, sql = entry.queries()[name], entry.oracle_sql().get(name)
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return bool(got), f"rows-only {len(got)} rows", t1 - t0, 0.0
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    t2 = time.time()
    c1, r1 = rows_of(df.columns, got)
    c2, r2 = rows_of(cols, want)
    if c1 != c2:
        return False, f"columns {c1} != {c2}", t1 - t0, t2 - t1
    kinds1 = [{type(r[i]).__name__ for r in r1 if r[i] is not None} for i in range(len(c1))]
    kinds2 = [{type(r[i]).__name__ for r in r2 if r[i] is not None} for i in range(len(c2))]
    if len(r1) != len(r2):
        return False, f"rows {len(r1)} != {len(r2)}; {r1[:2]} vs {r2[:2]}", t1 - t0, t2 - t1
    if r1 != r2:
        bad = [(a, b) for a, b in zip(r1, r2) if a != b]
        return False, f"{len(bad)} of {len(r1)} rows differ\n {c1}\n {bad[0][0]}\n {bad[0][1]}", t1 - t0, t2 - t1
    if kinds1 != kinds2:
        return False, f"types {list(zip(c1, kinds1, kinds2))}", t1 - t0, t2 - t1
    return True, f"{len(r1)} rows" + (" EMPTY" if not r1 else ""), t1 - t0, t2 - t1


def main(argv):
    from helixframe.session import build_session
    sf = argv[0] if argv else "0.01"
    names = argv[1:] or list(entry.queries())
    names = [n for pat in names for n in entry.queries() if n == pat or (pat.endswith("*") and n.startswith(pat[:-1]))]
    sf_dir = f"{DATA}/sf{sf}"
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    failed = []
    for n in names:
        try:
            ok, msg, ts, td = compare(spark, con, sf_dir, n)
        except Exception as e:  # report and go on
            ok, msg, ts, td = False, f"{type(e).__name__}: {str(e)[:900]}", 0, 0
        print(f"{'ok  ' if ok else 'FAIL'} {n:28s} spark {ts:6.2f}s duck {td:6.2f}s  {msg}", flush=True)
        if not ok:
            failed.append(n)
    print("failed:", failed)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
