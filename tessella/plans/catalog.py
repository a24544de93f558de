"""All registered queries of the core library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import graph_queries, problems, text_queries

_PARTS = [problems, graph_queries, text_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.ORACLE.items()}
