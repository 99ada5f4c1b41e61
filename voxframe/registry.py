"""Registered queries of the image-analytics operators, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle is not None:
        _ORACLES[name] = oracle


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(_ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voxframe import queries_raster

    return queries_raster.flagship(spark, sf_dir)


def load() -> None:
    """Import the modules that register queries."""
    from voxframe import queries_points, queries_raster, queries_tables, queries_verbs  # noqa: F401
