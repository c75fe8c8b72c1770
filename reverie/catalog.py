"""All queries of the library by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules of ``reverie.plans``; each has QUERIES and SQL.
PLANS: tuple[str, ...] = ("recall", "ledgers", "histories", "relational", "services")

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in PLANS:
        found |= import_module(f"reverie.plans.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in PLANS:
        found |= import_module(f"reverie.plans.{name}").SQL
    return found
