"""Registry of named queries and, where SQL can express them, their oracle text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def r6(expr: str, digits: int = 6) -> str:
    """SQL rounding that never yields a negative zero."""
    return f"(round(cast({expr} as double), {digits}) + 0.0)"


def frac(num: str, den: str, empty: str = "0.0") -> str:
    return f"(case when ({den}) <> 0 then cast({num} as double) / ({den}) else {empty} end)"
