"""Register of driver queries: each Spark plan next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(value: Column) -> Column:
    """Round for comparison; adding zero removes the sign of a negative zero."""
    return F.round(value, 6) + 0.0


def r6_sql(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"
