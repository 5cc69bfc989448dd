"""Run registered queries and their oracle SQL side by side.

    python tests/oracle_check.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pyarrow as pa
from pyspark.sql import SparkSession

import __spark_entry__ as entry_module

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("skysift-check")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def kind(t: pa.DataType) -> str:
    if pa.types.is_integer(t):
        return f"int{t.bit_width}"
    if pa.types.is_large_string(t) or pa.types.is_string(t):
        return "string"
    return str(t)


def rows_of(table: pa.Table) -> tuple[list[str], list[str], list[tuple]]:
    names = sorted(table.column_names)
    table = table.select(names)
    kinds = [kind(f.type) for f in table.schema]
    return names, kinds, sorted(zip(*[c.to_pylist() for c in table.columns]), key=repr)


def compare(left: pa.Table, right: pa.Table) -> str:
    ln, lk, lr = rows_of(left)
    rn, rk, rr = rows_of(right)
    if ln != rn:
        return f"columns {ln} != {rn}"
    if lk != rk:
        return f"types { {n: (a, b) for n, a, b in zip(ln, lk, rk) if a != b} }"
    if len(lr) != len(rr):
        return f"rows {len(lr)} != {len(rr)}"
    bad = [(a, b) for a, b in zip(lr, rr) if a != b]
    if bad:
        return f"{len(bad)} of {len(lr)} rows differ, first {dict(zip(ln, zip(*bad[0])))}"
    return "ok" if lr else "ok (EMPTY)"


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    sf_dir = f"/root/testdata/sf{args.sf}"
    queries, oracles = entry_module.queries(), entry_module.oracle_sql()
    spark, con = session(), oracle(sf_dir)
    names = [n for n in queries if not args.names or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args.names)]
    failed = []
    for name in names:
        started = time.time()
        try:
            got = queries[name](spark, sf_dir).toArrow()
            mid = time.time()
            if name in oracles:
                verdict = compare(got, con.execute(oracles[name]).to_arrow_table())
            else:
                verdict = "ok (rows only)"
            print(f"{name:28s} {verdict}  rows={got.num_rows} spark={mid - started:.1f}s duck={time.time() - mid:.1f}s", flush=True)
        except Exception as error:
            verdict = "error"
            print(f"{name:28s} ERROR {type(error).__name__}: {str(error)[:700]}", flush=True)
        if not verdict.startswith("ok"):
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} match; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
