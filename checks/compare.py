"""Run registered queries and their SQL side by side: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from checks.oracle import ORACLE
from checks.queries import REGISTERED
from negmine.shipping import ship
from negmine.staging import stage_scope

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def open_oracle(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    with stage_scope(spark):
        df = REGISTERED[name](spark, sf_dir)
        got_columns, got = rows_of(df.columns, df.collect())
    spent = time.time() - started
    if name not in ORACLE:
        return True, f"rows only: {len(got)} ({spent:.1f} s)"
    started = time.time()
    found = con.execute(ORACLE[name])
    want_columns, want = rows_of([d[0] for d in found.description], found.fetchall())
    note = f"{len(got)} rows, Spark {spent:.1f} s, SQL {time.time() - started:.1f} s"
    if got_columns != want_columns:
        return False, f"columns {got_columns} against {want_columns}"
    if got != want:
        differ = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return False, f"{note}; {len(got)} against {len(want)} rows; {differ}"
    return True, note


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(REGISTERED)
    spark = (SparkSession.builder.master("local[8]").appName("compare")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    con = open_oracle(sf_dir)
    failed = 0
    for name in names:
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as error:  # report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
