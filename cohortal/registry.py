"""The registry of queries: a builder and, where SQL can express it, its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def half_up_sql(x: str, digits: int) -> str:
    """Half-up rounding after the noise of summation, as the operators round."""
    return f"round(round(({x})::DECIMAL(38, 10), {digits + 4}), {digits})::DOUBLE"


def query(sql: str | None):
    """Register a builder under its own name, with its oracle SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add
