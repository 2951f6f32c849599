"""All queries of the core, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, navigation, packs, quality, ranking, store

MODULES = (ranking, code, packs, quality, navigation, store)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.context_plan(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
