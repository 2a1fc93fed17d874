"""Named queries over the given tables, with the SQL that checks them."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evospark.plans.views import portable_sql
from evospark.session import configure

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its independent formulation. The query runs
    with the package's adaptive settings, whoever created the session."""

    def add(fn: Query) -> Query:
        @functools.wraps(fn)
        def configured(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)

        QUERIES[name] = configured
        if sql is not None:
            CHECKS[name] = portable_sql(sql)
        return fn

    return add
