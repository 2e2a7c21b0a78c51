"""Registry: query name -> (DataFrame builder over the tables, DuckDB SQL or None)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import tables, with_tables

MODULES = ["scans", "sinks", "predicates", "text", "aggregates", "retrieval", "graphs", "similar", "lifecycle", "trees", "folds", "extras"]
_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register fn(tables) -> DataFrame under a name, with the SQL that gives the same rows."""

    def add(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return add


def sql_of(name: str) -> str:
    """The SQL of a query registered before, for one that builds on it."""
    return _SQL[name]


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"mnemolake.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: (lambda spark, sf_dir, fn=fn: fn(tables(spark, sf_dir))) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: with_tables(sql) for name, sql in _SQL.items()}
