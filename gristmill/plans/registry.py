"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.plans import corpus_queries, evaluation_queries, proxy_queries, storage_queries

_ALL = corpus_queries.QUERIES | evaluation_queries.QUERIES | proxy_queries.QUERIES | storage_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql is not None}
