"""Run registered queries in Spark and their DuckDB oracle side by side and compare.

    python tests/oracle_check.py [sf_dir] [name ...]

Comparison: same row count, same column names (sorted), and the same multiset of rows
after sorting columns by name; doubles compared after rounding to 9 significant digits.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from roadwise.sources.tables import TABLES  # noqa: E402

DEFAULT_SF = "/root/testdata/sf0.01"


def duck_conn(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET enable_progress_bar = false")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = [tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    sdf = fn(spark, sf_dir).toPandas()
    ts = time.time() - t
    t = time.time()
    ddf = con.execute(sql).df()
    td = time.time() - t
    msg = []
    if sorted(sdf.columns) != sorted(ddf.columns):
        msg.append(f"columns differ: spark-only {sorted(set(sdf.columns) - set(ddf.columns))} "
                   f"duck-only {sorted(set(ddf.columns) - set(sdf.columns))}")
    if len(sdf) != len(ddf):
        msg.append(f"rows {len(sdf)} vs {len(ddf)}")
    if not msg:
        a, b = normalise(sdf), normalise(ddf)
        if a != b:
            cols = sorted(sdf.columns)
            bad = [c for i, c in enumerate(cols) if [r[i] for r in a] != [r[i] for r in b]]
            diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
            msg.append(f"values differ in {bad[:8]}; e.g. {diff[:1]}")
    status = "OK " if not msg else "BAD"
    print(f"{status} {name:32s} rows={len(sdf):7d} spark={ts:6.2f}s duck={td:6.2f}s {'; '.join(msg)}", flush=True)
    return not msg


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else DEFAULT_SF
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as entry
    from roadwise.session import get_session
    spark = get_session()
    con = duck_conn(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    ok = True
    for name in names or sorted(q):
        if name not in o:
            n = q[name](spark, sf_dir).count()
            print(f"RWS {name:32s} rows={n:7d} (no oracle)")
            continue
        try:
            ok &= compare(spark, con, name, q[name], o[name], sf_dir)
        except Exception as e:  # report and continue
            ok = False
            print(f"ERR {name:32s} {type(e).__name__}: {str(e)[:400]}")
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv))
