"""Registered queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: Iterable[str] | None = None, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; `sql` is the same question for DuckDB over the named derived views."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_views(views, sql) if views else sql.strip()
        return fn

    return register


def scaled(value: Column | str, digits: int = 9) -> Column:
    """A double as a whole number of 10^-digits, so both engines compare exactly."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value * F.lit(10.0**digits) + F.lit(0.5)).cast("bigint")


def sql_scaled(value: str, digits: int = 9) -> str:
    return f"CAST(floor(({value}) * 1e{digits} + 0.5) AS BIGINT)"
