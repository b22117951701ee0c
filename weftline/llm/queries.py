"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import centroids, languages, lexical, lines, pieces, quality, records, secrets, shards, simhash, templates, topk, urls

MODULES = (quality, shards, urls, pieces, templates, simhash, lines, languages, secrets, topk, records, lexical, centroids)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in getattr(module, "ORACLE_SQL", {}).items()}
