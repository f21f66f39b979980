"""All queries of the library over the test tables, with their SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumiframe import plans
from lumiframe.plans import registry


def _load() -> None:
    for m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")):
        importlib.import_module(f"lumiframe.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
