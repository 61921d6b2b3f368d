"""Registered queries and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with DuckDB SQL where SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in a part of a table that is spread.
PART_ROWS = 500_000


def parts(df: DataFrame) -> int:
    """The number of parts of some 500,000 rows in ``df``, one a core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` dealt out by ``columns`` to as many :func:`parts`, so that what a task holds does not grow with the table."""
    return df.repartition(parts(df), *columns)
