"""Registered queries of the core library, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import aggregates, extensions, graphs, joins, rows, scalars, star, storage, streams, times, windows  # noqa: F401  they fill the register
from tessera.plans.registry import ORACLE, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
