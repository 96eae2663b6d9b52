"""Run registered queries next to their SQL and compare rows. Usage: check_oracle.py [sf_dir] [name-part ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v.is_integer() and abs(v) < 1e15 else round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    rel = con.execute(sql)
    want_cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} != {sorted(want_cols)}"
    cols = sorted(want_cols)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    idx = [want_cols.index(c) for c in cols]
    exp = sorted((tuple(norm(r[i]) for i in idx) for r in want), key=repr)
    if got == exp:
        return None
    g, e = set(got), set(exp)
    return f"rows {len(got)} vs {len(exp)}; only spark {sorted(g - e, key=repr)[:3]}; only sql {sorted(e - g, key=repr)[:3]}"


def main():
    import __spark_entry__ as entry
    from dredgeline.session import get_spark

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = get_spark(spark__ui__showConsoleProgress="false"), duck(sf)
    qs, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in qs:
        if args and not any(a in name for a in args):
            continue
        t = time.time()
        try:
            df = qs[name](spark, sf)
            diff = compare(df, con, sql[name]) if name in sql else (None if df.count() >= 0 else "")
            mid = f"rows={df.count()}" if name not in sql else ("" if diff is None else diff)
        except Exception as exc:  # noqa: BLE001
            diff = mid = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += diff is not None
        print("ok  " if diff is None else "FAIL", name, "" if name in sql else "(rows only)", round(time.time() - t, 2), mid[:900], flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
