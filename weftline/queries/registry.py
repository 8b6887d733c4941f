"""Queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """Collects functions (spark, sf_dir) -> DataFrame and the SQL that gives the same rows."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            key = name or f.__name__
            self.queries[key] = f
            if sql is not None:
                self.sql[key] = " ".join(sql.split("\n"))
            return f

        return add


def quoted(text: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + text.replace("'", "''") + "'"
