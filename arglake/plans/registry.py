"""Registration of queries with their oracle SQL."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracle = {}, {}

    def __call__(self, sql: str | None = None):
        """Register a query under the function's name, with its oracle SQL if SQL can express it."""

        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracle[f.__name__] = sql
            return f

        return add
