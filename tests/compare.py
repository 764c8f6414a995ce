"""Compare queries with their SQL: python tests/compare.py [sf] [name...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    import glob

    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        q = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{q}')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("T", " ").replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    rel = con.sql(sql)
    names = list(rel.columns)
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def main(argv):
    import __spark_entry__ as e
    from kbspark.session import local_session

    sf = argv[0] if argv else "0.01"
    spark = local_session("compare")
    spark.sparkContext.setLogLevel("ERROR")
    d = f"/root/testdata/sf{sf}"
    con = duck(d)
    qs, sql = e.queries(), e.oracle_sql()
    bad = 0
    for k in argv[1:] or qs:
        t = time.time()
        try:
            c, a = rows_of_spark(qs[k](spark, d))
            t1 = time.time()
            if k not in sql:
                print(f"{k}: {len(a)} rows, no SQL, {t1 - t:.1f}s", flush=True)
                continue
            c2, b = rows_of_sql(con, sql[k])
            ok = c == c2 and a == b
            print(f"{k}: {'ok' if ok else 'DIFF'} {len(a)} {len(b)} rows, {t1 - t:.1f}s / {time.time() - t1:.1f}s", flush=True)
            if not ok:
                bad += 1
                x, y = set(a), set(b)
                print("   ", c, c2, "only spark", list(x - y)[:3], "only sql", list(y - x)[:3])
        except Exception as ex:
            bad += 1
            print(f"{k}: ERROR {str(ex)[:1500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
