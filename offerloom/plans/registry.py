"""The registered queries over the offer view, each beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerloom.sources.tables import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: bool = True):
    """Register a query; its SQL may use the views stores and offers."""

    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"WITH {VIEWS}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().lstrip('+')}" if views else sql
        return f

    return register


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A parameter table of literal rows."""
    return spark.createDataFrame(rows, schema)
