"""All queries for the reference's own operators, with the DuckDB SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgrain.plans import checks, chunking, ingest, retrieval, texts

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = (texts, chunking, retrieval, checks, ingest)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
