"""How a module of plans registers its queries."""

from __future__ import annotations

from collections.abc import Callable


def new_register() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """``(queries, checks, decorator)``; the decorator takes the query's name and, where SQL can express it, its check."""
    queries: dict[str, Callable] = {}
    checks: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def register(fn: Callable) -> Callable:
            queries[name] = fn
            if sql is not None:
                checks[name] = sql
            return fn

        return register

    return queries, checks, query
