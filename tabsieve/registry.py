"""Registered queries: a Spark callable and (where SQL can say it) the DuckDB
twin for every operator of the inventory. Keys follow the operator names;
the registrations live in ``tabsieve.catalog``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


_loaded = False


def _load() -> None:
    global _loaded
    if _loaded:
        return
    _loaded = True
    from tabsieve.catalog import quality_checks  # noqa: F401
    from tabsieve.catalog import exploration  # noqa: F401
    from tabsieve.catalog import inventory  # noqa: F401
    from tabsieve.catalog import treatments  # noqa: F401
    from tabsieve.catalog import repairs  # noqa: F401
    from tabsieve.catalog import modeling  # noqa: F401



def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(ORACLES)
