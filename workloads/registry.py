"""Collects a module's queries and the SQL each must agree with."""

from __future__ import annotations


class Registry:
    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def register(f):
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return register
