"""The registry of queries, each with its SQL where SQL can express it. All of them read whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(tables: str, sql: str | None):
    """Registers a function of the named tables under its own name."""

    def register(build: Callable[..., DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables.split()))
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return register
