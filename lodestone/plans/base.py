"""Registration of queries with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    """Queries of one module: name -> function of (spark, sf_dir), and SQL for those that SQL can express."""

    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def register(query: Callable) -> Callable:
            self.queries[query.__name__] = query
            if sql is not None:
                self.oracle[query.__name__] = sql
            return query

        return register
