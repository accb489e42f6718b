"""Run registered queries in Spark and their oracle SQL in DuckDB, and compare results.

Usage: python tests/oracle_compare.py [sf_dir] [name-substring ...]
Comparison: same column names, same row count, same multiset of rows after rounding
doubles to 6 decimals (columns sorted by name, as the driver does).
"""

from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if hasattr(v, "asDict"):
        return str(v.asDict(recursive=True))
    if isinstance(v, (list, tuple)):
        return str([_norm(x) for x in v])
    if hasattr(v, "item"):
        return v.item()
    if type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return v


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(_norm(r[c]) for c in scols) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(srows), spark_s=round(t1 - t0, 2))
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = [tuple(_norm(x) for x in r) for r in res.fetchall()]
    out = dict(name=name, rows=len(srows), oracle_rows=len(drows), spark_s=round(t1 - t0, 2))
    if sorted(scols) != sorted(dcols):
        out.update(ok=False, why=f"columns {sorted(scols)} vs {sorted(dcols)}")
        return out
    order = sorted(range(len(scols)), key=lambda i: scols[i])
    dorder = [dcols.index(scols[i]) for i in order]
    key = lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, (list, dict)) else str(x)) for x in r)
    a = sorted([tuple(r[i] for i in order) for r in srows], key=key)
    b = sorted([tuple(r[i] for i in dorder) for r in drows], key=key)
    if a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        out.update(ok=False, why=f"values differ, e.g. {diff}" if diff else f"row count {len(a)} vs {len(b)}")
        return out
    out.update(ok=True)
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    filt = argv[2:]
    from foldline.session import get_spark
    from foldline.plans.registry import all_queries
    spark = get_spark("oracle-compare", master="local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, (fn, sql) in all_queries().items():
        if filt and not any(f in name for f in filt):
            continue
        try:
            r = compare(spark, con, name, fn, sql, sf_dir)
        except Exception as e:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(e).__name__}: {str(e)[:400]}")
        if r.get("ok") is False:
            bad += 1
        print(r, flush=True)
    print(f"FAILED: {bad}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
