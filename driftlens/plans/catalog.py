"""Query catalogue: one entry per operator, with the equivalent SQL where SQL
can state it. Areas register themselves on import."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.plans.views import Views

_QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
AREAS = ["sources", "scalars", "predicates", "aggregates", "behaviour", "topics", "graph", "evidence", "streams"]


def query(name: str, sql: str | None = None):
    """Registers a query; ``sql`` is its side-by-side check."""
    def add(fn: Callable[[Views], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return add


def load() -> None:
    for area in AREAS:
        import_module(f"driftlens.plans.catalog_{area}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()

    def bind(fn):
        return lambda spark, sf_dir: fn(Views(spark, sf_dir))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)


# -- export boundary: plain columns that compare across engines --------------
def ts(column: str | Column) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def joined(column: str | Column) -> Column:
    return F.concat_ws(",", column)


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


def sql_ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"
