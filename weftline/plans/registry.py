"""Queries over the driver's tables, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.plans import families, sets_and_trees, statistics_and_networks, stores, thresholds_and_loci

MODULES = (sets_and_trees, thresholds_and_loci, families, stores, statistics_and_networks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
