"""Registering queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[[str | None], Callable[[Query], Query]]]:
    """Queries and SQL by name, and the decorator that fills them; a query without SQL is tested against brute force."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def query(statement: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            queries[f.__name__] = f
            if statement:
                sql[f.__name__] = statement
            return f

        return keep

    return queries, sql, query
