"""Registry of the queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *inputs: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the named fixtures as tables."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = fixtures.with_ctes(list(inputs), sql)
        return fn

    return register
