"""Queries of this subpackage and their SQL twins, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TWINS: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register `fn(spark, folder) -> DataFrame` under `name`."""

    def register(fn):
        QUERIES[name] = fn
        if sql:
            TWINS[name] = sql
        return fn

    return register
