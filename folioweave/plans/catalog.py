"""All queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folioweave.operators import communities, extract, graph, interchange, recall, resolve, segment, vectors

_MODULES = [recall, segment, extract, resolve, graph, communities, vectors, interchange]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
