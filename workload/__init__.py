"""Queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = (
    "queue", "history", "reports", "evaluation", "addresses", "texts", "markup", "answers", "rules", "logs", "registries", "streams", "storage",
)


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with its SQL twin when SQL can express it on whole tables."""

    def register(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def load_all() -> None:
    for module in MODULES:
        import_module(f"workload.{module}")
