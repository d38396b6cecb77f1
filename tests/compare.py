"""Runs registered queries and their SQL in DuckDB side by side."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# Spark type name -> DuckDB type name
TYPE_NAMES = {
    "boolean": "BOOLEAN",
    "int": "INTEGER",
    "bigint": "BIGINT",
    "float": "FLOAT",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "timestamp": "TIMESTAMP",
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')"
        )
    return connection


def ordered(frame: pd.DataFrame) -> pd.DataFrame:
    columns = sorted(frame.columns)
    return frame[columns].sort_values(columns).reset_index(drop=True)


def difference(spark, sf_dir, query, sql) -> str | None:
    """None if both engines return the same typed bag of rows."""
    result = query(spark, sf_dir)
    relation = duck(sf_dir).sql(sql)
    spark_types = {n: TYPE_NAMES.get(t, t) for n, t in result.dtypes}
    duck_types = {n: str(t) for n, t in zip(relation.columns, relation.types)}
    if spark_types != duck_types:
        return f"types differ: {spark_types} / {duck_types}"
    left, right = ordered(result.toPandas()), ordered(relation.df())
    if len(left) != len(right):
        return f"rows differ: {len(left)} / {len(right)}"
    for column in left.columns:
        unequal = left[column].to_numpy() != right[column].to_numpy()
        unequal &= ~(left[column].isna() & right[column].isna()).to_numpy()
        if unequal.any():
            at = unequal.nonzero()[0]
            return f"{column} differs in {len(at)} rows, first\n{left.loc[at[0]]}\n{right.loc[at[0]]}"
    return None if len(left) else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    directory = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    sqls = entry.oracle_sql()
    for name, query in entry.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        if name in sqls:
            outcome = difference(session, directory, query, sqls[name]) or "equal"
        else:
            outcome = f"{query(session, directory).count()} rows, no SQL"
        print(f"{name:20} {time.time() - start:6.1f}s  {outcome}", flush=True)
