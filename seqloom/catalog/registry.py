"""Where the queries of all catalogue modules meet."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
COVERS: dict[str, list[str]] = {}


def query(covers: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function name, with the inventory rows it covers and its SQL form."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        COVERS[fn.__name__] = covers.split()
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return add


MODULES = [
    "alignments", "augmentation", "benchmark", "columns", "complexes", "filtering", "outcomes", "plans", "selection",
    "sequences", "structures", "tables",
]


def load() -> None:
    """Imports the catalogue modules, which register their queries."""
    for name in MODULES:
        importlib.import_module(f"seqloom.catalog.{name}")
