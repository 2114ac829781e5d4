"""Register of the corpus queries: a Spark callable and, where SQL can say it, its DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(call):
        QUERIES[name] = call
        if sql is not None:
            ORACLES[name] = sql
        return call

    return keep
