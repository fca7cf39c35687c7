"""Every core query by name, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lemmata.plans import applied_queries, etl_queries, misc_queries, search_queries, text_queries

MODULES = (text_queries, etl_queries, search_queries, misc_queries, applied_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for m in MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in MODULES:
        out |= m.ORACLE_SQL
    return out
