"""Local stand-in for the driver's correctness gate.

Runs each registered Spark query and its DuckDB oracle on one scale factor
and compares row count, column names and an order-insensitive value hash.
Usage: python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return f"{round(float(v), 6):.6f}"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, dt.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(v, dt.date):
        return v.isoformat()
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def explain_diff(scols, srows, dcols, drows, key_n=2):
    """Per-column differences for rows matched on the first key columns."""
    di = [dcols.index(c) for c in scols]
    dmap = {}
    for r in drows:
        rr = [r[i] for i in di]
        dmap.setdefault(tuple(norm(x) for x in rr[:key_n]), rr)
    diffs = {}
    for r in srows:
        k = tuple(norm(x) for x in r[:key_n])
        if k not in dmap:
            diffs.setdefault("<missing key in duck>", []).append(k)
            continue
        for c, a, b in zip(scols, r, dmap[k]):
            if norm(a) != norm(b):
                diffs.setdefault(c, []).append((k, norm(a), norm(b)))
    for c, v in list(diffs.items())[:12]:
        print(f"   diff {c}: n={len(v)} e.g. {v[:2]}")


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    import __spark_entry__ as e
    from profilebook.session import build_session
    spark = build_session()
    con = duck(sf_dir)
    qs, sqls = e.queries(), e.oracle_sql()
    names = names or list(qs)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = qs[n](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as ex:  # noqa: BLE001
            print(f"{n:32s} SPARK ERROR {str(ex)[:300]}")
            bad += 1
            continue
        ts = time.time() - t0
        if n not in sqls:
            print(f"{n:32s} rows={len(srows)} (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[n])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as ex:  # noqa: BLE001
            print(f"{n:32s} DUCKDB ERROR {str(ex)[:300]}")
            bad += 1
            continue
        hs, ls = digest(scols, srows)
        hd, ld = digest(dcols, drows)
        ok = len(srows) == len(drows) and sorted(scols) == sorted(dcols) and hs == hd
        bad += not ok
        print(f"{n:32s} {'OK ' if ok else 'BAD'} rows={len(srows)}/{len(drows)} {ts:.1f}s")
        if not ok:
            if sorted(scols) != sorted(dcols):
                print("   cols spark-only", sorted(set(scols) - set(dcols)), "duck-only", sorted(set(dcols) - set(scols)))
            else:
                explain_diff(scols, srows, dcols, drows)
                sd, dd = set(ls), set(ld)
                order = sorted(scols)
                for x in list(sd - dd)[:2]:
                    print("   spark:", x[:900])
                for x in list(dd - sd)[:2]:
                    print("   duck: ", x[:900])
                print("   cols:", "|".join(order)[:900])
    print("bad:", bad)


if __name__ == "__main__":
    main()
