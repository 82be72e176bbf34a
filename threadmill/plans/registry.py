"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadmill.plans import engine_queries, graph_queries, maintenance_queries, search_queries, session_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = text_queries.QUERIES | session_queries.QUERIES | search_queries.QUERIES | graph_queries.QUERIES | maintenance_queries.QUERIES | source_queries.QUERIES | engine_queries.QUERIES


def queries() -> dict[str, Query]:
    return {n: f for n, (f, _) in ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {n: s for n, (_, s) in ALL.items() if s is not None}
