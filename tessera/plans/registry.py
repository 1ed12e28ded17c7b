"""All registered queries and their SQL, but for those of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("copy", "history", "board", "site", "corpus", "rules", "markup", "spans", "store", "streams")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in import_module(f"tessera.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in MODULES for k, sql in import_module(f"tessera.plans.{m}").ORACLES.items()}
