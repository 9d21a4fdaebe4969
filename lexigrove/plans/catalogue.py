"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexigrove.plans import around, content, process, search, turns

_PLANS = (search, content, process, around, turns)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for plan in _PLANS for k, v in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for plan in _PLANS for k, v in plan.ORACLE.items()}
