"""Run registered queries next to their SQL in DuckDB: python check.py [sf] [name prefix...]"""

from __future__ import annotations

import math
import sys
import time

import duckdb

import entries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v) if v != 0 else "0"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows), [names[i] for i in order]


def connect(path):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{path}/{t}.parquet')")
    return con


SPENT: list[float] = []
SAME = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}


def compare(spark, con, path, name):
    """Empty string when both sides agree, else what differs."""
    df = entries.QUERIES[name](spark, path)
    collected = [tuple(r) for r in df.collect()]
    SPENT.append(time.time())
    got, names = rows_of(df.columns, collected)
    sql = entries.ORACLE.get(name)
    if sql is None:
        return f"rows only: {len(got)}" if got else "FAIL: no rows"
    cur = con.execute(sql)
    want, want_names = rows_of([d[0] for d in cur.description], cur.fetchall())
    if names != want_names:
        return f"FAIL: columns {names} / {want_names}"
    types = {d[0]: str(d[1]) for d in con.execute(f"select column_name, column_type from (describe {sql})").fetchall()}
    for c, t in df.dtypes:
        if SAME.get(t) != types[c]:
            return f"FAIL: type of {c}: {t} / {types[c]}"
    if len(got) != len(want):
        return f"FAIL: rows {len(got)} / {len(want)}\n   {got[:2]}\n   {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"FAIL: {len(bad)} of {len(got)} rows differ\n   {names}\n   {bad[0][0]}\n   {bad[0][1]}"
    return "" if got else "FAIL: no rows"


def main():
    from tabwork.session import session

    entries.load_all()
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    prefixes = tuple(sys.argv[2:])
    path = f"/root/testdata/{sf}"
    spark = session(
        "check", "local[8]", spark__ui__enabled="false", spark__sql__shuffle__partitions="8", spark__driver__memory="12g"
    )
    spark.sparkContext.setLogLevel("OFF")
    con = connect(path)
    failed = 0
    for name in entries.QUERIES:
        if prefixes and not name.startswith(prefixes):
            continue
        t0 = time.time()
        SPENT.clear()
        try:
            said = compare(spark, con, path, name)
        except Exception as e:
            said = "FAIL: " + str(e)[:600]
        failed += said.startswith("FAIL")
        spark_time = (SPENT[0] if SPENT else time.time()) - t0
        print(f"{name:36s} {spark_time:6.2f}s {said or 'ok'}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
