"""Where registered queries put themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def registered(name: str, check: str | None = None) -> Callable[[Query], Query]:
    """Register the query under ``name``, with the SQL text that checks it where there is one."""
    def put(query: Query) -> Query:
        QUERIES[name] = query
        if check is not None:
            CHECKS[name] = check
        return query

    return put
