"""A decorator that collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


def collector() -> tuple[dict, dict[str, str], Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(fn):
            queries[fn.__name__] = fn
            if sql:
                oracles[fn.__name__] = sql
            return fn

        return add

    return queries, oracles, query
