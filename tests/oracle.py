"""Runs registered queries against DuckDB over the same tables and compares all values."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


# Queries without SQL; they have tests of their own.
UNCHECKED = (
    "op1_lattice_likelihood", "op2_ngram_jaccard", "op3_prefix_hashes", "op5_bpe_automaton", "op6_counterfactual_toxicity", "op7_quality_network",
    "op9_bootstrapped_pii", "pipeline",
)


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, int):
        return float(v) if abs(v) < 2**53 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return v


def rows_of(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, folder: str, name: str, fn, sql: str | None):
    """(ok, message)"""
    t = time.time()
    df = fn(spark, folder)
    got_rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return name in UNCHECKED, f"no SQL: {len(got_rows)} rows, {took:.1f}s"
    t = time.time()
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    want = rows_of(names, out.fetchall())
    oracle_took = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} <> {sorted(names)}"
    got = rows_of(df.columns, got_rows)
    tail = f"{len(got)} rows, spark {took:.1f}s duckdb {oracle_took:.1f}s"
    if got == want:
        return True, tail
    only_got = [r for r in got if r not in set(want)][:3]
    only_want = [r for r in want if r not in set(got)][:3]
    return False, f"{len(got)} <> {len(want)} rows; columns {sorted(names)}\n  spark only {only_got}\n  duckdb only {only_want} ({tail})"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from placemill.session import local_session

    import argparse

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.001")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark, con = local_session(), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            ok, message = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, message, flush=True)
    print("failed:", bad)
