"""Run a named query on Spark and its SQL on DuckDB, and compare the results."""

from __future__ import annotations

import glob
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from oracle.queries import oracle_sql  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def compare(spark, con, name: str, query, sf_dir: str) -> str | None:
    """A description of the first difference, or None."""
    frame = query(spark, sf_dir)
    ours = _rows(frame.columns, frame.collect())
    result = con.execute(oracle_sql()[name])
    columns = [c[0] for c in result.description]
    theirs = _rows(columns, result.fetchall())
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}"
    if len(ours) != len(theirs):
        extra = set(ours) ^ set(theirs)
        return f"rows {len(ours)} / {len(theirs)}; {sorted(extra, key=repr)[:4]}"
    for a, b in zip(ours, theirs):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a}\n    / {b}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    from cmdlode.plans.catalog import catalog

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir, only = sys.argv[1], sys.argv[2:]
    con = connect(sf_dir)
    for name, query in catalog().items():
        if (only and name not in only) or name not in oracle_sql():
            continue
        started = time.time()
        try:
            problem = compare(spark, con, name, query, sf_dir)
        except Exception as error:  # noqa: BLE001 - a report of every query is wanted
            problem = f"{type(error).__name__}: {str(error)[:500]}"
        print(f"{'ok  ' if problem is None else 'DIFF'} {name:28s} {time.time() - started:6.1f}s {problem or ''}", flush=True)


if __name__ == "__main__":
    main()
