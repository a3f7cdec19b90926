"""Compare registered queries with their SQL: python -m catalog.check SF_DIR [name ...]"""

from __future__ import annotations

import sys
import tempfile
import time

import duckdb
import pandas as pd

from catalog import fixtures, oracles, queries


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    # Spill outside the working folder.
    db = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="spark-duckdb-")})
    for name in fixtures.TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def fingerprint(frame: pd.DataFrame) -> tuple[list[str], int, int]:
    """Column names, row count and an order-free hash of the values."""
    names = sorted(frame.columns)
    if frame.empty:
        return names, 0, 0
    text = pd.DataFrame()
    for n in names:
        column = frame[n]
        text[n] = column.map(lambda v: f"{v:.6f}") if column.dtype.kind == "f" else column.astype(str)
    return names, len(frame), int(pd.util.hash_pandas_object(text, index=False).to_numpy().sum())


def compare(spark, db, sf_dir: str, name: str, sql: str) -> tuple[bool, str]:
    t0 = time.time()
    ours = fingerprint(queries.QUERIES[name](spark, sf_dir).toPandas())
    t1 = time.time()
    theirs = fingerprint(db.execute(sql).df())
    t2 = time.time()
    same = ours == theirs
    detail = f"{ours[1]} rows, {t1 - t0:.1f} s, sql {t2 - t1:.1f} s"
    return same, detail if same else f"{detail}\n   spark {ours}\n   sql   {theirs}"


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, bad = connect(sf_dir), 0
    sqls = oracles.oracle_sql()
    for name in names or sqls:
        try:
            same, detail = compare(spark, db, sf_dir, name, sqls[name])
        except Exception as problem:
            same, detail = False, f"{type(problem).__name__}: {str(problem)[:600]}"
        bad += not same
        print("ok  " if same else "FAIL", name, detail, flush=True)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1].rstrip("/"), sys.argv[2:]) > 0)
