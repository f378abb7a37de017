"""Run registered queries next to their SQL twins: ``python tests/verify_queries.py [pattern] [sf]``."""

import math
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if not v.is_integer() or abs(v) > 1e15 else str(int(v))
    return str(v)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, name, fn, sql, sf):
    import duckdb

    begin = time.time()
    out = fn(spark, sf)
    got = [tuple(r) for r in out.collect()]
    took = time.time() - begin
    if sql is None:
        return ("rows" if got else "EMPTY"), f"{len(got)} rows, no SQL", took
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(out.columns):
        return "COLUMNS", f"{sorted(out.columns)} vs {sorted(cols)}", took
    a, b = rows_of(out.columns, got), rows_of(cols, want)
    if len(a) != len(b):
        return "COUNT", f"{len(a)} vs {len(b)}", took
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return "VALUES", f"{len(bad)}/{len(a)} differ {sorted(cols)}: {bad[:2]}", took
    return ("ok" if a else "EMPTY"), f"{len(a)} rows", took


def main():
    pattern = sys.argv[1] if len(sys.argv) > 1 else "."
    sf = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.001"
    import __spark_entry__ as entry
    from flowsieve.session import build_session

    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                              "spark.sql.ansi.enabled": os.environ.get("ANSI", "true"),
                              "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if not re.search(pattern, name):
            continue
        try:
            state, note, took = compare(spark, name, fn, oracles.get(name), sf)
        except Exception as e:  # report and go on with the next query
            state, note, took = "ERROR", re.sub(r"\s+", " ", f"{type(e).__name__} {e}")[:600], 0
        bad += state not in ("ok", "rows")
        print(f"{state:8s} {name:40s} {took:6.2f}s {note}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
