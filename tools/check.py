"""Run registered queries against their check SQL in DuckDB.

    python tools/check.py [folder] [query ...]
"""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from sitefold.plans.catalog import CHECKS, QUERIES  # noqa: E402
from sitefold.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            x = r[i]
            if isinstance(x, float):
                x = None if math.isnan(x) else x + 0.0
            vals.append(x)
        out.append(tuple(vals))
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (int, float)) or isinstance(x, bool) else (x is None, "n", x) for x in t))


def compare(spark, con, folder, name):
    df = QUERIES[name](spark, folder)
    got = normal([tuple(r) for r in df.collect()], df.columns)
    if name not in CHECKS:
        return "rows only", len(got), ""
    cur = con.execute(CHECKS[name])
    cols = [d[0] for d in cur.description]
    want = normal(cur.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return "COLUMNS", len(got), f"{sorted(df.columns)} vs {sorted(cols)}"
    if len(got) != len(want):
        return "ROWS", len(got), f"want {len(want)}; {[g for g in got if g not in want][:2]}; {[w for w in want if w not in got][:2]}" if len(got) < 3000 else f"want {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = {tuple(type(x).__name__ for x in g) == tuple(type(x).__name__ for x in w) for g, w in zip(got[:50], want[:50])}
    if bad:
        return "VALUES", len(got), f"{len(bad)} differ, e.g. {bad[0]}"
    return "ok" if kinds <= {True} else "ok (types differ)", len(got), ""


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names:
        t = time.time()
        try:
            status, n, note = compare(spark, con, folder, name)
        except Exception as e:  # report and go on
            status, n, note = "ERROR", 0, f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name:28s} {status:18s} rows={n:<8d} {time.time() - t:6.1f}s {note}", flush=True)
