"""Run registered queries against their oracles: ``python -m contract.check [--sf DIR] [name-prefix ...]``."""

from __future__ import annotations

import argparse
import math
import time

import duckdb

from contract import load_all
from contract.registry import ORACLES, QUERIES
from mailgrain.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (int, float)):
        number = float(value)
        return None if math.isnan(number) else round(number, 5) + 0.0
    try:
        return round(float(value), 5) + 0.0
    except (TypeError, ValueError):
        return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(row[i]) for i in order] for row in rows), key=repr)


def compare(spark, connection, sf_dir, name):
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return f"rows-only n={len(got)}", took
    cursor = connection.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"COLUMNS {sorted(set(columns) ^ set(df.columns))}", took
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if len(a) != len(b):
        return f"ROWS spark={len(a)} oracle={len(b)}", took
    for x, y in zip(a, b):
        if x != y:
            names = sorted(columns)
            diff = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
            wrong = sum(p != q for p, q in zip(a, b))
            return f"VALUES {wrong}/{len(a)} rows, first: {str(diff)[:700]}", took
    return f"ok n={len(a)}", took


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    load_all()
    spark = build_session(
        "check", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad = 0
    for name in QUERIES:
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            verdict, took = compare(spark, connection, args.sf, name)
        except Exception as problem:
            verdict, took = f"ERROR {str(problem)[:900]}", 0.0
        bad += not verdict.startswith(("ok", "rows-only"))
        print(f"{name:40s} {took:6.2f}s {verdict}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
