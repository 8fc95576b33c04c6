"""Registered queries over the given tables, each with its oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("selecting", "preparing", "graphs", "traversing", "history", "facts", "archetypes",
            "similarity", "diffs", "scoring", "outcomes", "sequences", "sourcing", "explaining")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    for m in _MODULES:
        importlib.import_module(f"causeway.suite.{m}")
