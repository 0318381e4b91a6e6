"""Queries of the spatial engine by name, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilewright.plans import graph, roads, routes, scalars, search, store, streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (scalars, routes, store, search, graph, roads, streams):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
