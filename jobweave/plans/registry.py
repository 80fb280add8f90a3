"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    """Register a query; ``sql`` is omitted where SQL cannot state the result."""

    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def half_up(numerator: str, denominator: str, digits: int) -> str:
    """SQL for ``numerator / denominator`` rounded half up, from integers only."""
    scale = 10**digits
    top, bottom = f"({numerator})", f"({denominator})"
    return (
        f"CAST(((2 * {scale} * CAST({top} AS HUGEINT) + {bottom}) // nullif(2 * {bottom}, 0)) AS DOUBLE)"
        f" / CAST({scale} AS DOUBLE)"
    )


def cents_avg(amount: str, digits: int = 2) -> str:
    """SQL for the average of a money expression, rounded half up."""
    cents = f"sum(CAST(round(({amount}) * 100) AS HUGEINT))"
    scale = 10**digits
    return (
        f"CAST((2 * {scale} * {cents} + 100 * count({amount})) // nullif(200 * count({amount}), 0) AS DOUBLE)"
        f" / CAST({scale} AS DOUBLE)"
    )
