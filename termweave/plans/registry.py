"""Registered queries: name -> Spark function, and the equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from termweave.plans.fixtures import with_tables

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the common table expressions named in ``tables``."""

    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = with_tables(tables, sql)
        return function

    return add
