"""Where queries of the file index are registered, each with the DuckDB SQL that it is held against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.fixtures import Index, with_views

NOW = 1_705_000_000_000
_MODULES = ("catalog", "records", "evidence", "streams", "stores")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a function of an Index as a query; views: the stand-in tables that the SQL reads."""

    def keep(fn: Callable[[Index], DataFrame]) -> Callable:
        _QUERIES[name] = lambda spark, sf_dir: fn(Index(spark, sf_dir))
        if sql is not None:
            _ORACLES[name] = with_views(sql, *views.split())
        return fn

    return keep


def found() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str]]:
    """All queries, and the SQL of those that have one."""
    for module in _MODULES:
        importlib.import_module(f"corvane.plans.{module}")
    return dict(_QUERIES), dict(_ORACLES)
