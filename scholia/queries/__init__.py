"""Registered queries: each runs an operator over whole tables, with check SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from scholia.tables import table, with_clause

MODULES = ("identifiers", "linkage", "statistics", "texts", "planning", "reports")
_RUN: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


class Inputs:
    """Gives a query its tables and views by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __call__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


def query(name: str, views: str = "", sql: str | None = None):
    """Register ``fn(inputs)`` under a name, with the SQL that must agree with it."""

    def keep(fn: Callable[[Inputs], DataFrame]):
        _RUN[name] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql is not None:
            _SQL[name] = _with_views(views.split(), sql.strip())
        return fn

    return keep


def _with_views(views: list[str], sql: str) -> str:
    prefix = with_clause(views)
    if not prefix:
        return sql
    for head in ("WITH RECURSIVE ", "WITH "):
        if sql.startswith(head):
            return head + prefix.removeprefix("WITH ") + ",\n" + sql.removeprefix(head)
    return prefix + "\n" + sql


def _load() -> None:
    for module in MODULES:
        import_module(f"scholia.queries.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_RUN)


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
