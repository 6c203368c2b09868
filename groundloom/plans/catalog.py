"""The registry of named queries: a Spark callable and, where SQL can say it, the oracle."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from groundloom.plans.tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES = ("terrain", "walks", "cameras", "splats", "meshes", "images", "records", "logs", "repairs", "solves", "storage")


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``sql`` is its oracle."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = with_views(sql, *views.split())
        return fn

    return wrap


def load() -> None:
    for m in MODULES:
        importlib.import_module(f"groundloom.plans.{m}")
