"""Run registered queries in Spark and their oracle SQL in DuckDB; compare like the driver.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, rows spark / oracle, and whether the value hashes agree.
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6))
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ")
    return str(v)


def digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16], lines


def main() -> int:
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from eventide.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    qs, orc = queries(), oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        dt = time.time() - t
        if name not in orc:
            print(f"{name:28s} spark={len(rows):7d} (no oracle) {dt:.1f}s")
            continue
        try:
            res = con.execute(orc[name])
            ocols = [d[0] for d in res.description]
            orows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ORACLE-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        h1, l1 = digest(cols, rows)
        h2, l2 = digest(ocols, orows)
        same_cols = sorted(cols) == sorted(ocols)
        ok = same_cols and h1 == h2 and len(rows) == len(orows)
        bad += not ok
        print(f"{name:28s} spark={len(rows):7d} oracle={len(orows):7d} cols={'ok' if same_cols else 'DIFF'} "
              f"hash={'ok' if h1 == h2 else 'DIFF'} {dt:.1f}s")
        if not ok:
            if not same_cols:
                print("   spark cols ", sorted(cols), "\n   oracle cols", sorted(ocols))
            s1, s2 = set(l1), set(l2)
            for x in sorted(s1 - s2)[:3]:
                print("   spark only :", x[:300])
            for x in sorted(s2 - s1)[:3]:
                print("   oracle only:", x[:300])
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
