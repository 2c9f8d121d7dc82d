"""Names of all queries, each with its DataFrame plan and, where SQL can say it, its oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES: tuple[str, ...] = ("relational", "retrieval", "text", "ops", "ingest", "listings", "records", "scale")
_loaded = False


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under ``name``."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = fn
        if oracle:
            _ORACLES[name] = oracle
        return fn

    return add


def _load() -> None:
    global _loaded
    if not _loaded:
        for m in _MODULES:
            importlib.import_module(f"marlstone.plans.{m}")
        _loaded = True


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
