"""All queries of the core library, each with its DuckDB oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldloom.plans import analytics_queries, polygon_queries, quality_queries, raster_queries, vector_queries

Query = Callable[[SparkSession, str], DataFrame]

#: Modules with QUERIES (name -> query) and ORACLES (name -> DuckDB SQL).
MODULES = [vector_queries, polygon_queries, raster_queries, analytics_queries, quality_queries]


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
