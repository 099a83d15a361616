"""Queries by operator id, each with the SQL that says the same, if SQL can."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from treeline.session import ship

Query = Callable[[SparkSession, str], DataFrame]


def shipped(fn: Query) -> Query:
    """The query, with this package sent to the executors first."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ship(spark), sf_dir)

    return run


@dataclass
class Registry:
    """Named queries; the first of a name is kept, as its callers rely on it."""

    held: dict[str, tuple[Query, str | None]] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a query ``(spark, sf_dir) -> DataFrame`` under ``name``."""

        def keep(fn: Query) -> Query:
            self.held.setdefault(name, (fn, sql))
            return fn

        return keep

    def queries(self) -> dict[str, Query]:
        load()
        return {name: shipped(fn) for name, (fn, _) in self.held.items()}

    def oracle_sql(self) -> dict[str, str]:
        load()
        return {name: sql for name, (_, sql) in self.held.items() if sql is not None}


registry = Registry()


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for name in MODULES:
        importlib.import_module(f"treeline.plans.{name}")


#: Modules of ``treeline.plans`` that register queries.
MODULES: list[str] = ["tree", "scalars", "work", "documents", "more", "streams", "formats", "tables", "grammars", "inclusion", "sequences", "codes", "rest"]
