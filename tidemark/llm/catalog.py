"""Registered queries of this package and their SQL oracles.

Every query reads its whole table, runs its operator with production
parameters and derives the returned columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def keep(query):
        LLM_QUERIES[name] = query
        if sql:
            LLM_ORACLES[name] = sql
        return query
    return keep


from tidemark.llm import queries  # noqa: E402,F401  fills the registry
