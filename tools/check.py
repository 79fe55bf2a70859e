"""Local correctness gate: run Spark queries and their DuckDB oracles side by side.

Usage: python tools/check.py [--sf /root/testdata/sf0.01] [key ...]
Reports row count, schema (name + type) and an order-insensitive value hash,
plus a tolerant comparison (floats to 9 significant digits) to tell float noise
from real differences.
"""

from __future__ import annotations

import argparse
import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

SPARK_TO_DUCK = {
    "IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
    "DateType": "DATE", "BooleanType": "BOOLEAN", "FloatType": "FLOAT", "ShortType": "SMALLINT",
    "ByteType": "TINYINT", "TimestampNTZType": "TIMESTAMP", "TimestampType": "TIMESTAMP WITH TIME ZONE",
}


def _norm(v, tol):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        if math.isnan(v):
            return "NULL"
        if tol:
            return f"{v:.9g}"
        return repr(v)
    if hasattr(v, "item"):
        return _norm(v.item(), tol)
    return str(v)


def _rows_hash(rows, cols_sorted_idx, tol):
    lines = sorted("|".join(_norm(r[i], tol) for i in cols_sorted_idx) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()[:12], lines


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--show", type=int, default=3)
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()

    from lanespark.session import get_session
    from lanespark.plans import registry
    registry.load_all()
    spark = get_session()
    con = duckdb.connect()
    for t in TABLES:
        p = f"{a.sf}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    keys = a.keys or sorted(registry.QUERIES)
    n_ok = n_bad = n_rows_only = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = registry.QUERIES[k](spark, a.sf)
            srows = [tuple(r) for r in sdf.collect()]
            sschema = [(f.name, SPARK_TO_DUCK.get(type(f.dataType).__name__, f.dataType.simpleString()))
                       for f in sdf.schema.fields]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {k}: spark error {type(e).__name__}: {str(e)[:400]}")
            n_bad += 1
            continue
        ts = time.time() - t0
        if k not in registry.ORACLES:
            print(f"ROWS  {k}: {len(srows)} rows (no oracle) {ts:.1f}s")
            n_rows_only += 1
            continue
        try:
            rel = con.sql(registry.ORACLES[k])
            drows = rel.fetchall()
            dschema = [(n, str(t)) for n, t in zip(rel.columns, rel.types)]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {k}: duckdb error {str(e)[:400]}")
            n_bad += 1
            continue
        problems = []
        if len(srows) != len(drows):
            problems.append(f"rows spark={len(srows)} duck={len(drows)}")
        if sorted(sschema) != sorted(dschema):
            problems.append(f"schema spark={sorted(sschema)} duck={sorted(dschema)}")
        sidx = [i for _, i in sorted((n, i) for i, (n, _) in enumerate(sschema))]
        didx = [i for _, i in sorted((n, i) for i, (n, _) in enumerate(dschema))]
        hs, ls = _rows_hash(srows, sidx, False)
        hd, ld = _rows_hash(drows, didx, False)
        exact = hs == hd
        if not exact:
            ts_, lst = _rows_hash(srows, sidx, True)
            td_, ldt = _rows_hash(drows, didx, True)
            if ts_ == td_:
                ds = sorted(set(ls) - set(ld))[: a.show]
                dd = sorted(set(ld) - set(ls))[: a.show]
                problems.append(f"float-noise only (equal at 9 significant digits) spark-only={ds} duck-only={dd}")
            else:
                diff_s = sorted(set(lst) - set(ldt))[: a.show]
                diff_d = sorted(set(ldt) - set(lst))[: a.show]
                problems.append(f"values differ; spark-only={diff_s} duck-only={diff_d}")
        if problems:
            n_bad += 1
            print(f"BAD   {k}: " + "; ".join(problems))
        else:
            n_ok += 1
            print(f"OK    {k}: {len(srows)} rows {ts:.1f}s")
    print(f"\nexact={n_ok} bad={n_bad} rows_only={n_rows_only} total={len(keys)}")


if __name__ == "__main__":
    main()
