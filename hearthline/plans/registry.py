"""Names, Spark queries and checking SQL of everything registered."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from hearthline.plans.views import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, check: str | None = None):
    """Register ``function(views)``; in ``check`` a view is written as ``{points}`` and so on."""

    def register(function: Callable[[Views], DataFrame]):
        QUERIES[name] = lambda spark, folder: function(Views(spark, folder))
        if check is not None:
            text = check
            for view, select in SQL.items():
                text = text.replace("{" + view + "}", select)
            CHECKS[name] = text
        return function

    return register


def load_all() -> None:
    for module in ("rollups", "tiers", "dashboard", "ingest", "normalize", "health", "control", "streams"):
        import_module(f"hearthline.plans.{module}")
