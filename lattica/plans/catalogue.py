"""Named queries over the fixture tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.plans import corpus_queries, graph_queries, policy_queries, record_queries, request_queries, structure_queries

PARTS = (graph_queries, corpus_queries, record_queries, structure_queries, request_queries, policy_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
