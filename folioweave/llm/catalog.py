"""All queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_MODULES = [importlib.import_module(f"{__package__}.{m.name}") for m in pkgutil.iter_modules([str(Path(__file__).parent)]) if m.name[0] == "p" and m.name[1].isdigit()]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}
