"""Run registered queries next to their SQL twins in DuckDB and compare all values.

python check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def rows_of(names: list[str], rows: list) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple((type(_cell(r[i])).__name__, _cell(r[i])) for i in order) for r in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None, may_be_empty: bool = False) -> tuple[bool, str]:
    started = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - started
    if sql is None:
        return len(got) > 0, f"{len(got)} rows, no twin, {took:.2f}s"
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = con.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b and (got or may_be_empty):
        return True, f"{len(got)} rows, {took:.2f}s"
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return False, f"{len(got)} vs {len(want)} rows; spark only ({len(only_a)}): {only_a[:3]}; sql only ({len(only_b)}): {only_b[:3]}"


def main() -> int:
    from panelwright.plans.catalog import QUERIES, SQL
    from panelwright.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:] or list(QUERIES)
    folder = os.environ.get("CHECKPOINT_DIR", "/tmp/panelwright-checkpoints")
    settings = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.checkpoint.dir": folder}
    spark = build_session(master="local[8]", **settings)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in wanted:
        try:
            ok, note = compare(spark, con, sf_dir, QUERIES[name], SQL.get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
