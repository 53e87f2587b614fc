"""Per-section collector of queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, tuple[str, dict[str, str]]] = {}

    def add(self, name: str, sql: str | None = None, **local: str):
        """Register the decorated function; ``sql`` may name views and shared tables,
        which are prefixed as common table expressions when the SQL is handed out."""

        def wrap(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = (sql, local)
            return fn

        return wrap
