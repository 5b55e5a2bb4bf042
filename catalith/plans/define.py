"""How plan modules declare queries: a decorator that files a function under its name with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    """The queries of one module."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None) -> Callable:
        def file(function: Callable) -> Callable:
            self.queries[function.__name__] = function
            if sql is not None:
                self.oracles[function.__name__] = sql
            return function

        return file
