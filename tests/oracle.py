"""Compare registered queries with their SQL: `python tests/oracle.py [-s SF] [names…]`."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if type(value).__name__ == "Decimal":
        return norm(float(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder, name, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if sql is None:
        return None, f"rows only, {len(got)} rows, {took:.1f}s"
    start = time.time()
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = rows_of(cols, cur.fetchall())
    sql_took = time.time() - start
    note = f"{len(got)} rows, {took:.1f}s (sql {sql_took:.1f}s)"
    if sorted(cols) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} vs {sorted(cols)}"
    if got != want:
        gs, ws = set(map(repr, got)), set(map(repr, want))
        only_got = sorted(gs - ws)[:3]
        only_want = sorted(ws - gs)[:3]
        return False, f"values differ ({len(got)} vs {len(want)} rows)\n  cols {sorted(cols)}\n  spark {only_got}\n  sql   {only_want}"
    types = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    odd = [t for t in types if t[1].startswith(("array", "map", "struct"))]
    return bool(got), note + (f" nested {odd}" if odd else "")


if __name__ == "__main__":
    from quire.plans import oracles, registered
    from quire.session import build_session, use_local_folder

    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    use_local_folder(spark)
    con = connect(folder)
    qs, sqls = registered(), oracles()
    names = [n for n in qs if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, folder, name, qs[name], sqls.get(name))
        except Exception as e:
            ok, note = False, "".join(traceback.format_exception_only(e))[:900]
        if ok is False:
            bad.append(name)
        print({True: "ok  ", False: "BAD ", None: "rows"}[ok], name, note, flush=True)
    print("bad:", len(bad), "of", len(names), " ".join(bad))
