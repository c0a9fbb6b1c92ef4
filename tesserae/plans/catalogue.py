"""Registry of the queries offered by ``__spark_entry__``: a Spark plan and its SQL twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tesserae.plans.oracle_views import with_views
from tesserae.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_MODULES = (
    "queries_tokens",
    "queries_dataset",
    "queries_status",
    "queries_tree",
    "queries_grid",
    "queries_raster",
    "queries_vectors",
    "queries_boxes",
    "queries_jobs",
    "queries_streaming",
)


def query(name: str, sql: str | None = None, *views: str):
    """Register ``plan(tables) -> DataFrame`` under ``name`` with its SQL text, if any."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return plan(Tables(spark, folder))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_views(sql, *views)
        return plan

    return register


def load() -> None:
    for module in _MODULES:
        importlib.import_module(f"tesserae.plans.{module}")
