"""Every query of the engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from offerlens.plans import board_queries, build_queries, crawl_queries, feed_queries, landed_queries, registry_queries, text_queries, venue_queries

_MODULES = (feed_queries, registry_queries, text_queries, board_queries, venue_queries, crawl_queries, build_queries, landed_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for module in _MODULES for name, text in module.ORACLES.items()}
