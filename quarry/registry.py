"""All queries of the library by name. Modules register with ``@query(name, oracle)``."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
_MODULES = [f"quarry.operators.{m}" for m in ("checks", "deals", "feeds", "filters", "health", "joins", "listing_text", "ranking", "rules", "schedules", "stats", "streams", "vocab", "windows")]


def query(name: str, oracle: str | None = None):
    """Register a query under ``name`` with the DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are named {name}")
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["active_board"](spark, sf_dir)
