"""The table of registered queries: a Spark callable and, where one exists, its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from heliograde.sources import tables

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn(spark, sf)``; ``sql`` may use the named views."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = tables.sql(sql, *views)
        return fn

    return wrap
