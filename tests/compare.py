"""Run the registered queries against their oracles: python tests/compare.py [folder] [key prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, bool):
        return repr(v)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted(tuple(plain(row[i]) for i in at) for row in cur.fetchall())


def main(folder, prefixes):
    import __spark_entry__ as e
    from plenum.session import local_session

    spark = local_session(8)
    con = duck(folder)
    queries, oracles = e.queries(), e.oracle_sql()
    bad = []
    for key, run in queries.items():
        if prefixes and not any(key.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            cols, rows = spark_rows(run(spark, folder))
        except Exception as ex:  # report and go on
            bad.append(key)
            print(f"FAIL {key}: {str(ex)[:1500]}")
            continue
        took = time.time() - t
        if key not in oracles:
            print(f"rows {key}: {len(rows)} rows, {took:.2f}s")
            continue
        try:
            ocols, orows = duck_rows(con, oracles[key])
        except Exception as ex:
            bad.append(key)
            print(f"FAIL {key} (oracle): {str(ex)[:1500]}")
            continue
        if cols != ocols:
            bad.append(key)
            print(f"DIFF {key}: columns {cols} against {ocols}")
        elif rows != orows:
            bad.append(key)
            print(f"DIFF {key}: {len(rows)} rows against {len(orows)}")
            left, right = set(rows) - set(orows), set(orows) - set(rows)
            print("   spark only", [str(x)[:400] for x in sorted(left)[:2]])
            print("   oracle only", [str(x)[:400] for x in sorted(right)[:2]])
        else:
            print(f"ok   {key}: {len(rows)} rows, {took:.2f}s")
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    args = sys.argv[1:]
    folder = args[0] if args and "/" in args[0] else "/root/testdata/sf0.01"
    sys.exit(1 if main(folder, [x for x in args if "/" not in x]) else 0)
