"""Registered queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusframe.plans import model_sql
from corpusframe.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a function under its name; ``ctes`` names the shared definitions the SQL needs."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            _SQL[fn.__name__] = (sql, ctes)
        return fn

    return register


def oracles() -> dict[str, str]:
    return {name: model_sql.with_ctes(sql, ctes) for name, (sql, ctes) in _SQL.items()}
