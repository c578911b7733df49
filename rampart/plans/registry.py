"""Name -> query, and name -> oracle SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CATALOGS = [
    "text", "rules", "detection", "privacy", "effectiveness", "discovery", "threats", "usage",
    "limits", "experiments", "security", "traces", "quality", "sources", "streams",
]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def load_all() -> None:
    for part in CATALOGS:
        importlib.import_module(f"rampart.plans.{part}")
