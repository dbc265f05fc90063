"""Run every query in Spark and in DuckDB and compare all rows: ``check_oracles.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries
from plantlytics.session import get_spark


def normal(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return f"{round(value, 6) + 0.0:.6f}"
    return str(value)


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in data)


def database(sf_dir: str):
    db = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def compare(spark, db, sf_dir: str, name: str) -> str:
    """Empty text if equal, else what differs."""
    df = queries()[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cursor = db.execute(oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = dict(zip(columns, (str(c[1]) for c in cursor.description)))
    spark_kinds = dict(df.dtypes)
    names = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "timestamp_ntz": "TIMESTAMP", "date": "DATE", "boolean": "BOOLEAN"}
    odd = {c: (spark_kinds[c], kinds[c]) for c in columns if names[spark_kinds[c]] != kinds[c]}
    if odd:
        return f"types {odd}"
    if got != want:
        lost = [r for r in want if r not in set(got)][:3]
        extra = [r for r in got if r not in set(want)][:3]
        return f"rows {len(got)} != {len(want)}; missing {lost}; extra {extra}"
    return "" if got else "no rows"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(queries())
    spark = get_spark("check", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = database(sf_dir), 0
    for name in chosen:
        begin = time.time()
        try:
            problem = compare(spark, db, sf_dir, name)
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - begin:.1f}s {problem}", flush=True)
    print("without oracle:", sorted(set(queries()) - set(oracle_sql())), "failed:", failed)
    sys.exit(bool(failed))


if __name__ == "__main__":
    main()
