"""All registered queries of the engine and their oracle SQL.

A query is a callable (spark, sf_dir) -> DataFrame over whole tables; its SQL gives the same rows over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with ``sql`` as its oracle where SQL can say it."""

    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = build
        if sql is not None:
            ORACLE[name] = sql
        return build

    return add


def load_all() -> None:
    """Import every module of queries; each registers its own."""
    from gristmill.plans import activity, context, corpus, publishing, records, retrieval, reviews, usage, writes  # noqa: F401


load_all()
