"""Queries of the engine and the SQL that states what each must return."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that define QUERIES and SQL.
MODULES: tuple[str, ...] = tuple(f"siltstone.plans.{m}_queries" for m in ("search", "catalog", "text", "stream"))


def queries() -> dict[str, Query]:
    return {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(m).SQL.items()}
