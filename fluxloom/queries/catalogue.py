"""All queries of the engine's own operators, and the SQL that they are held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES: tuple[str, ...] = ("stat", "features", "similarity", "models", "folds", "lifecycle", "numbers")


class Registry:
    """Queries of one module: ``@query("name", sql)`` registers a function (spark, sf_dir) -> DataFrame."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def add(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return add


def _registries() -> list[Registry]:
    return [importlib.import_module(f"fluxloom.queries.{m}").query for m in MODULES]


def queries() -> dict[str, Query]:
    return {k: f for r in _registries() for k, f in r.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for r in _registries() for k, s in r.sql.items()}
