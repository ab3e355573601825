"""Run registered queries on Spark and their SQL oracles on DuckDB; compare.

    python tools/oracle_check.py [--sf /root/testdata/sf0.01] [key-regex ...]

Comparison: column names (sorted), row count, and an order-insensitive
multiset of rows.  Prints one line per key and a summary.
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import re
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from kiln.plans.registry import ORACLES, QUERIES, load_all  # noqa: E402
from kiln.session import get_session  # noqa: E402
from kiln.tables import TABLE_NAMES  # noqa: E402


def canon(v, approx):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) if approx else v
    if isinstance(v, decimal.Decimal):
        return float(v) if approx else v.normalize()
    if isinstance(v, (list, tuple)):
        return tuple(canon(x, approx) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, canon(x, approx)) for k, x in v.items()))
    if isinstance(v, dt.datetime) and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(table, approx):
    cols = sorted(table.column_names)
    data = table.select(cols).to_pylist()
    out = [tuple(canon(r[c], approx) for c in cols) for r in data]
    return cols, sorted(out, key=repr)


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("keys", nargs="*")
    a = ap.parse_args()
    load_all()
    spark = get_session("local[8]")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLE_NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{a.sf}/{t}.parquet')")
    keys = sorted(QUERIES)
    if a.keys:
        keys = [k for k in keys if any(re.search(p, k) for p in a.keys)]
    ok = bad = rows_only = 0
    for k in keys:
        t0 = time.time()
        try:
            sdf = QUERIES[k](spark, a.sf)
            st = sdf.toArrow()
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {k}: spark failed: {str(e).splitlines()[0][:300]}")
            traceback.print_exc(limit=3)
            continue
        ts = time.time() - t0
        if k not in ORACLES:
            rows_only += 1
            print(f"ROWS {k}: {st.num_rows} rows ({ts:.1f}s)")
            continue
        try:
            dtab = con.execute(ORACLES[k]).to_arrow_table()
            dtab = dtab.read_all() if hasattr(dtab, "read_all") else dtab
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERR  {k}: duckdb failed: {str(e).splitlines()[0][:300]}")
            continue
        sc, sr = rows_of(st, False)
        dc, dr = rows_of(dtab, False)
        if sc != dc:
            bad += 1
            print(f"BAD  {k}: columns differ spark={sc} duck={dc}")
            continue
        if len(sr) != len(dr):
            bad += 1
            print(f"BAD  {k}: rows spark={len(sr)} duck={len(dr)}")
            print("   spark:", sr[:3], "\n   duck: ", dr[:3])
            continue
        if sr == dr:
            ok += 1
            st_types = {f.name: str(f.type) for f in st.schema}
            du_types = {f.name: str(f.type) for f in dtab.schema}
            tdiff = {c: (st_types[c], du_types[c]) for c in st_types if st_types[c] != du_types.get(c)}
            note = f" TYPES {tdiff}" if tdiff else ""
            print(f"OK   {k}: {len(sr)} rows ({ts:.1f}s){note}")
            continue
        _, sa = rows_of(st, True)
        _, da = rows_of(dtab, True)
        diff = [(x, y) for x, y in zip(sr, dr) if x != y][:2]
        tag = "APPROX" if sa == da else "BAD "
        bad += 1
        print(f"{tag} {k}: values differ; schema spark={st.schema.types} duck={dtab.schema.types}")
        for x, y in diff:
            print("   spark:", x, "\n   duck: ", y)
    print(f"summary: ok={ok} bad={bad} rows_only={rows_only} total={len(keys)}")


if __name__ == "__main__":
    main()
