"""Registration of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from footfall.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; without ``sql`` it is checked by tests instead."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            ship_package(spark, Path(__file__).parent)
            return build(spark, sf.rstrip("/"))

        run.__name__, run.__doc__ = name, build.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return build

    return register
