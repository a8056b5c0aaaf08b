"""Where queries and their SQL twins are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB must return for the same tables."""

    def add(fn: Callable) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def cte(*parts: str, recursive: bool = False) -> str:
    """``WITH`` clause from common table expressions."""
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(p.strip() for p in parts if p.strip()) + "\n"
