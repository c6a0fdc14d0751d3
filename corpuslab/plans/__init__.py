"""Registered queries: operators applied to the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Collects a module's queries and the SQL that gives the same rows."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add
