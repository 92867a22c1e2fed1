"""A query is a function of (spark, sf_dir) with, where SQL can express it, a counterpart for an independent SQL engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries and their SQL text."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Decorator: register a query under ``name``, with ``sql`` as its counterpart if given."""

        def keep(fn: Query) -> Query:
            self.add(name, fn, sql)
            return fn

        return keep

    def add(self, name: str, fn: Query, sql: str | None = None) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} is registered twice")
        self.queries[name] = fn
        if sql is not None:
            self.sql[name] = sql.strip()
