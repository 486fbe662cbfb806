"""Run a registered query and its twin SQL side by side and compare rows, columns and values."""
from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return bool(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(repr(v)) + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    con.execute("set threads=8")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf_dir, name, queries, sqls):
    t0 = time.time()
    df = queries[name](spark, sf_dir)
    rows = df.collect()
    t1 = time.time()
    if name not in sqls:
        return "rows-only", len(rows), t1 - t0, None, ""
    rel = con.execute(sqls[name])
    dcols = [d[0] for d in rel.description]
    drows = rel.fetchall()
    t2 = time.time()
    sc, sr = rows_of(df.columns, rows)
    dc, dr = rows_of(dcols, drows)
    msg = ""
    if sc != dc:
        msg = f"columns {sc} vs {dc}"
    elif len(sr) != len(dr):
        msg = f"count {len(sr)} vs {len(dr)}"
    elif sr != dr:
        bad = [(a, b) for a, b in zip(sr, dr) if a != b]
        msg = f"{len(bad)} rows differ, first {bad[0]}"
    return ("ok" if not msg else "DIFF"), len(rows), t1 - t0, t2 - t1, msg


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from fairline.session import local_session
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session(os.environ.get("CPUS", "8"))
    con = duck(sf)
    qs, ss = e.queries(), e.oracle_sql()
    pats = sys.argv[1:]
    bad = 0
    for n in qs:
        if pats and not any(n == p or n.startswith(p) for p in pats):
            continue
        try:
            st, cnt, a, b, msg = compare(spark, con, sf, n, qs, ss)
        except Exception as ex:  # report and go on
            st, cnt, a, b, msg = "ERROR", -1, 0, 0, str(ex)[:int(os.environ.get("ERRLEN", "700"))]
        bad += st in ("DIFF", "ERROR")
        print(f"{st:9} {n:40} rows={cnt} spark={a:.2f}s sql={b if b is None else round(b, 2)} {msg}", flush=True)
    print("bad:", bad)
