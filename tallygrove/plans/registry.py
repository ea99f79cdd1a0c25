"""All queries over the driver's tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bundles, fronts, impact, panels, relations, texts

_PLANS = (impact, relations, texts, fronts, panels, bundles)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.ORACLES.items()}
