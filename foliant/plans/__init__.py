"""Registered queries over the driver's tables, by area."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.plans import cast, forms, inline, library, readers, reports, resolve, scripture, sources, structure, text, versions

MODULES: list = [text, structure, cast, resolve, reports, sources, library, forms, readers, versions, scripture, inline]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cast.c04_frequency(spark, sf_dir)
