"""Named queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    """Registers a query under its name; ``sql`` gives the same rows on any engine with the views of ``views``."""

    def put(query: Callable) -> Callable:
        QUERIES[query.__name__] = query
        if sql:
            ORACLES[query.__name__] = sql
        return query

    return put


def r6(expression: str) -> str:
    return f"round({expression} + 1e-9, 6)"
