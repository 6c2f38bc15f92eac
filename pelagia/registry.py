"""All registered queries by name; each module of pelagia.plans adds its own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "noise_method_summary_closed"
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def registered_sql(name: str) -> str:
    """The SQL of a query that is registered already."""
    return _sql[name]


def _load() -> None:
    from pelagia import plans

    plans.load()


def queries() -> dict[str, Query]:
    _load()
    return _queries


def oracle_sql() -> dict[str, str]:
    _load()
    return _sql
