"""The register of queries and of the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Adds a query of one argument, a function from a table's name to its DataFrame."""

    def add(query: Callable[[Callable[[str], DataFrame]], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: query(lambda which: table(spark, sf_dir, which))
        if sql:
            ORACLE[name] = sql
        return query

    return add
