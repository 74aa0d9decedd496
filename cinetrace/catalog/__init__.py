"""Registered queries: each Spark job next to its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinetrace.bindings import Tables, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MODULES = (
    "bindings_check",
    "frames",
    "detections",
    "captions",
    "behavior",
    "spans",
    "search",
    "graph",
    "replies",
    "context",
    "export",
    "keyed",
    "planning",
    "folds",
    "summaries",
    "streams",
)


def query(name: str, sql: str | None = None):
    """Register a job ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = lambda spark, root: fn(Tables(spark, root))
        if sql is not None:
            ORACLES[name] = oracle(sql)
        return fn

    return add


def load() -> None:
    """Register everything; importing a module again is free, whatever was imported before."""
    for module in _MODULES:
        importlib.import_module(f"cinetrace.catalog.{module}")
