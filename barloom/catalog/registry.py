"""Decorator that files a query and its twin under a name."""

from __future__ import annotations


class Registry:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.twins: dict = {}

    def add(self, name: str, sql: str | None = None):
        def deco(fn):
            self.queries[name] = fn
            if sql is not None:
                self.twins[name] = sql
            return fn

        return deco
