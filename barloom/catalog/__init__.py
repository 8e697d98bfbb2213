"""Registered queries and their DuckDB twins, grouped by topic."""

from __future__ import annotations

import importlib

TOPICS = ("bars", "indicators", "panels", "cross", "screens", "research", "live")


def _modules():
    return [importlib.import_module(f"{__name__}.{t}") for t in TOPICS]


def all_queries():
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_twins():
    return {k: v for m in _modules() for k, v in m.TWINS.items()}
