"""Run registered queries beside their DuckDB twins: python tools/check.py [--sf DIR] [names...]."""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import importlib
import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, int):
        return float(f"{float(v):.9g}") if abs(v) < 2**53 else v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in rows), key=repr)


def main() -> int:
    import duckdb

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--modules", default=None)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()

    import tidewright.queries as q
    from tidewright.session import local_session

    for m in args.modules.split(",") if args.modules else q.MODULES:
        importlib.import_module(f"tidewright.queries.{m}")
    names = args.names or list(q.REGISTRY)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{args.sf}/{t}.parquet'")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        query = q.REGISTRY[name]
        start = time.time()
        try:
            df = query.run(spark, args.sf)
            got_cols, got = df.columns, [tuple(r) for r in df.collect()]
            took = time.time() - start
            note = ""
            if query.oracle:
                cur = con.execute(query.oracle)
                want_cols = [d[0] for d in cur.description]
                want = cur.fetchall()
                types = dict(zip(want_cols, [str(d[1]) for d in cur.description]))
                stypes = dict(df.dtypes)
                if sorted(got_cols) != sorted(want_cols):
                    note = f"COLUMNS {sorted(got_cols)} != {sorted(want_cols)}"
                else:
                    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
                    if a != b:
                        extra = [r for r in a if r not in set(b)][:3]
                        miss = [r for r in b if r not in set(a)][:3]
                        note = f"DIFF rows {len(a)} vs {len(b)} cols={sorted(got_cols)}\n   spark-only {extra}\n   duck-only  {miss}"
                    else:
                        note = "ok"
                        odd = {c: (stypes[c], types[c]) for c in types if types[c] in ("HUGEINT", "INT128") or "DECIMAL" in types[c].upper()}
                        if odd:
                            note += f" (types {odd})"
            else:
                note = "rows-only"
            if not got:
                note += " EMPTY"
            if "ok" not in note[:2] and "rows-only" not in note:
                bad += 1
            print(f"{name:32s} {took:6.2f}s rows={len(got):6d} {note}", flush=True)
        except Exception as e:  # noqa: BLE001
            bad += 1
            msg = str(e) if "--full" in sys.argv else str(e)[:900]
            print(f"{name:32s} ERROR {type(e).__name__}: {msg}", flush=True)
            tb = traceback.extract_tb(e.__traceback__)
            for f in tb:
                if "tidewright" in f.filename:
                    print(f"     {f.filename}:{f.lineno} {f.line}")
    print("bad:", bad)
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(main())
