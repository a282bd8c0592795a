"""Name -> (Spark query, oracle SQL) registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .base_sql import compose

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
INVENTORY: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``ids`` names the inventory lines."""
    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        INVENTORY[name] = ids
        if sql is not None:
            ORACLES[name] = compose(sql)
        return fn
    return wrap
