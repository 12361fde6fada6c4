"""Where the query modules leave their queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with the SQL it is held against."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, since the order of a sum is not fixed."""
    kinds = dict(df.dtypes)
    chosen = columns or [c for c, k in df.dtypes if k == "double"]
    return df.withColumns({c: F.round(c, digits) for c in chosen if kinds[c] == "double"})


def longs(*columns: Column) -> list[Column]:
    return [c.cast("long") for c in columns]
