"""A query is a function of (spark, sf_dir) with the SQL of the same rows, where there is any."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def add(f):
            key = name or f.__name__
            self.queries[key] = f
            if sql:
                self.oracles[key] = sql
            return f

        return add
