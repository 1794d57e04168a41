"""Registered queries: name -> (spark, sf_dir) -> DataFrame, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Adds a query under its function's name; ``sql`` is what another engine runs for the same rows."""

    def add(query: Query) -> Query:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return add


def load() -> dict[str, Query]:
    """Imports the modules that register queries."""
    from apilattice.plans import bindings, more_bindings, sample_bindings, shape_bindings, source_bindings, stub_bindings, surface_bindings, upkeep_bindings  # noqa: F401

    return QUERIES
