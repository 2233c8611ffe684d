"""Registry of named queries, each with SQL for the same result where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function by its name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from quillflow.plans import aggregates, codes, documents, joins, layout, ledger, merges, reports, rules, scalars, streams, windows  # noqa: F401

    return QUERIES, ORACLES
