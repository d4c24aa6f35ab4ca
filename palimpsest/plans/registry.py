"""All queries of the engine and their oracle SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query under ``name``, with the DuckDB SQL that must give the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


from palimpsest.plans import admin, capture, control, coordination, filters, joins, leases, retrieval, search, text, timelines, trees  # noqa: E402, F401
# built on other queries' oracles
from palimpsest.plans import durable  # noqa: E402, F401
