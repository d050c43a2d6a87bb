"""Registry: each query on the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Registers ``f(tables) -> DataFrame`` under ``key``."""

    def put(f: Callable[[Tables], DataFrame]):
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql is not None:
            SQL[key] = sql
        return f

    return put
