"""Registers a query function together with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    queries: dict[str, Callable] = {}
    sql: dict[str, str] = {}

    def query(text: str | None = None) -> Callable:
        def put(f: Callable) -> Callable:
            queries[f.__name__] = f
            if text is not None:
                sql[f.__name__] = text
            return f

        return put

    return queries, sql, query
