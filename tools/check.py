"""Run registered queries beside their SQL in DuckDB and compare values.

    python tools/check.py [-d FOLDER] [name-or-prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def _cell(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _cell(x)) for k, x in v.items()))
    return str(v)


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, fn, sql, folder):
    df = fn(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(rows)}", True
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}", False
    a, b = canonical(rows, df.columns), canonical(want, names)
    if a != b:
        in_a, in_b = set(a), set(b)
        left = [x for x in a if x not in in_b][:3]
        right = [x for x in b if x not in in_a][:3]
        return f"DIFF spark={len(a)} sql={len(b)}\n   spark {str(left)[:900]}\n   sql   {str(right)[:900]}", False
    return f"ok {len(a)}", True


def main():
    from provisio.plans import catalog
    from provisio.session import local_session

    ap = argparse.ArgumentParser()
    ap.add_argument("-d", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.d}/{t}.parquet'")
    picked = [n for n in catalog.QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    bad = 0
    for name in picked:
        t = time.time()
        try:
            text, ok = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES.get(name), args.d)
        except Exception as e:  # noqa: BLE001
            text, ok = f"ERROR {type(e).__name__} {str(e)[:1200]}", False
        bad += not ok
        print(f"{name:32s} {time.time() - t:6.2f}s {text}", flush=True)
    print(f"{len(picked)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
