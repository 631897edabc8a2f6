"""The register that each module of queries fills."""

from __future__ import annotations

from collections.abc import Callable


def register() -> tuple[dict[str, Callable], dict[str, str], Callable]:
    """Empty dicts of queries and SQL, and the decorator that adds to them."""
    queries: dict[str, Callable] = {}
    oracle: dict[str, str] = {}

    def query(name: str, sql: str | None = None) -> Callable:
        def add(fn: Callable) -> Callable:
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn

        return add

    return queries, oracle, query
