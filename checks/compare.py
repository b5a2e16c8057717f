"""Runs registered queries and their twins side by side: python -m checks.compare <dir> [names]."""
from __future__ import annotations

import sys
import time

import duckdb

from docspark.session import build_session

from .queries import QUERIES, SQL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    out = []
    for r in frame.itertuples(index=False):
        out.append(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    return sorted(out, key=repr)


def main(d, names):
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    bad = 0
    for name in names or QUERIES:
        t0 = time.time()
        try:
            a = QUERIES[name](spark, d).toPandas()
        except Exception as e:  # report and go on
            bad += 1
            print(f"{name}: SPARK ERROR {str(e)[:600]}", flush=True)
            continue
        t1 = time.time()
        if name not in SQL:
            print(f"{name}: rows {len(a)} {t1 - t0:.1f}s (no twin)", flush=True)
            continue
        try:
            b = db.sql(SQL[name]).df()
        except Exception as e:
            bad += 1
            print(f"{name}: SQL ERROR {str(e)[:600]}", flush=True)
            continue
        t2 = time.time()
        x, y = rows_of(a), rows_of(b)
        ok = sorted(a.columns) == sorted(b.columns) and x == y
        kinds = {c: (str(a[c].dtype), str(b[c].dtype)) for c in a.columns if c in b.columns and str(a[c].dtype) != str(b[c].dtype)}
        print(f"{name}: {'ok' if ok else 'DIFFERENT'} rows {len(a)}/{len(b)} spark {t1 - t0:.1f}s sql {t2 - t1:.1f}s {kinds or ''}", flush=True)
        if not ok:
            bad += 1
            print("   cols", sorted(a.columns), sorted(b.columns))
            only = [r for r in x if r not in set(y)][:2], [r for r in y if r not in set(x)][:2]
            for side, rs in zip(("spark", "sql"), only):
                for r in rs:
                    print("  ", side, str(r)[:400])
    print("failing:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
