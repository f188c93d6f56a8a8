"""The registered queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import corpus_queries, service_queries, store_queries, stream_queries, text_queries

_MODULES = (corpus_queries, text_queries, store_queries, service_queries, stream_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name and function of each query, over the driver's tables."""
    return {name: run for module in _MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL by query name."""
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
