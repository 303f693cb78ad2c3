"""Holds queries against their SQL: python tests/compare.py DIR [NAME...]"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def duck(directory):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        path = f"{directory}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.select(*names).toLocalIterator()), key=repr)


def compare(spark, con, directory, query, sql):
    """None if they agree, else what differs."""
    names, got = rows_of(query(spark, directory))
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    want = sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if names != sorted(columns):
        return f"columns {names} and {sorted(columns)}"
    if got != want:
        a, b = set(map(repr, got)), set(map(repr, want))
        return f"{len(got)} and {len(want)} rows; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from vellumgrid.session import session

    spark = session(os.environ.get("COMPARE_MASTER", "local[8]"), **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, queries, bad = duck(sys.argv[1]), entry.queries(), 0
    for name, sql in entry.oracle_sql().items():
        if len(sys.argv) > 2 and not any(name.startswith(x) for x in sys.argv[2:]):
            continue
        began = time.time()
        try:
            said = compare(spark, con, sys.argv[1], queries[name], sql)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:600]}"
        if said:
            bad += 1
            print(f"{name}: {said[:900]}", flush=True)
        elif time.time() - began > 5:
            print(f"{name}: {time.time() - began:.0f} s")
    print("bad", bad)
