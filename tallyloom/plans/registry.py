"""Registered queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under a name, with its DuckDB SQL where there is one."""

    def add(f: Query) -> Query:
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if oracle:
            _ORACLES[name] = oracle
        return f

    return add


def sql_of(name: str) -> str:
    """The SQL of a query that is registered already, for another that must give the same rows."""
    return _ORACLES[name]


def _load() -> None:
    from tallyloom.plans import acts, directory, dossiers, filters, integrity, joins, lookups, models, monitoring, pages, people, records, scalars, tallies, views  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
