"""Run the registered queries against their SQL: ``python -m checks.compare [dir] [names...]``."""

from __future__ import annotations

import datetime
import math
import sys
import tempfile
import time

import duckdb
from pyspark.sql import SparkSession

from . import oracles
from .fixtures import BASE
from .queries import registered


def normal(value):
    if value is None:
        return "∅"
    if isinstance(value, float):
        return "∅" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(row[i]) for i in order) for row in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str, run, sql: str | None):
    """Status line and whether the query matches; without SQL nothing is compared, and the line says so."""
    started = time.time()
    df = run(spark, sf_dir)
    spark_rows = df.collect()
    spent = time.time() - started
    line = f"{name:36s} {len(spark_rows):7d} rows {spent:6.1f}s"
    if sql is None:
        return f"{line}  UNCHECKED, no SQL", True
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"{line}  COLUMNS {sorted(set(names) ^ set(df.columns))}", False
    got, want = rows_of(df.columns, spark_rows), rows_of(names, wanted)
    if got == want:
        kinds = {n: (type(a).__name__, type(b).__name__) for n, a, b in _types(df.columns, spark_rows, names, wanted)}
        odd = {n: k for n, k in kinds.items() if k[0] != k[1]}
        return f"{line}  ok {odd or ''}", True
    first = next((i for i, (a, b) in enumerate(zip(got, want)) if a != b), min(len(got), len(want)))
    diff = [
        (c, a, b) for c, a, b in zip(sorted(names), *(x[first] if first < len(x) else ("-",) * len(names) for x in (got, want)))
        if a != b
    ]
    return f"{line}  DIFFERS ({len(want)} wanted) {diff[:6]}", False


def _types(columns, rows, names, wanted):
    for name in columns:
        i, j = columns.index(name), names.index(name)
        a = next((r[i] for r in rows if r[i] is not None), None)
        b = next((r[j] for r in wanted if r[j] is not None), None)
        yield name, a, b


def main(sf_dir: str = "/root/testdata/sf0.01", *only: str) -> int:
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="lupa-"))
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf_dir), oracles.oracle_sql(), []
    for name, run in registered().items():
        if only and name not in only:
            continue
        try:
            line, fine = compare(spark, con, sf_dir, name, run, sqls.get(name))
        except Exception as error:
            line, fine = f"{name:36s} FAILED {str(error)[:500]}".replace("\n", " | "), False
        print(line, flush=True)
        if not fine:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(min(1, main(*sys.argv[1:])))
