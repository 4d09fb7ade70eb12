"""Registry of table queries: name -> (query, check SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""

    def wrap(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            CHECKS[fn.__name__] = sql
        return fn

    return wrap


def rounded(frame: DataFrame, **digits: int) -> DataFrame:
    """Round the named double columns for comparison."""
    return frame.withColumns({c: F.round(F.col(c), d) for c, d in digits.items()})
