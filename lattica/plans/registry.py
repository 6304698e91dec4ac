"""Registers a query over the fixture tables with its SQL."""

from __future__ import annotations

from lattica.plans.fixtures import Tables


def registry():
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(name: str, sql: str | None = None):
        def add(f):
            queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if sql:
                oracles[name] = sql
            return f

        return add

    return queries, oracles, query
