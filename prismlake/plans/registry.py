"""All queries: name to query, and name to SQL. Modules of queries add theirs when they are imported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from prismlake.plans.standins import FILES, TS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL for it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def over_files(select: str, *more: str) -> str:
    return f"WITH {', '.join([FILES, f't AS (SELECT *, {TS} AS ts FROM files)', *more])} {select}"
