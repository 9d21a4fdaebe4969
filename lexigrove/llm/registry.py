"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ("line_dedup", "toxicity", "substring_dedup", "mixing", "bpe", "top_k", "pii", "near_dedup", "sharding", "embedding_dedup", "hard_negatives", "importance", "quality")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for name in _MODULES:
        module = import_module(f"lexigrove.llm.{name}")
        found |= {k: v for k, v in vars(module).items() if k.startswith("op") and callable(v)}
    return found


def oracle_sql() -> dict[str, str]:
    found = {}
    for name in _MODULES:
        found |= getattr(import_module(f"lexigrove.llm.{name}"), "ORACLE", {})
    return found
