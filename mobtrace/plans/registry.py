"""Names, Spark callables and oracle SQL of the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; ``sql`` gives the same rows in DuckDB, where SQL can express them."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def load() -> None:
    """Imports the modules that register queries."""
    from mobtrace.plans import aggregates, changes, documents, interests, joins, models, reads, scalars, sequences, sources, streams  # noqa: F401
