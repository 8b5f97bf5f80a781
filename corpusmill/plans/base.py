"""Registered queries: name, Spark function and, where SQL can say it, the same result in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        @functools.wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(ship_package(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shown(ts, name: str | None = None):
    """A timestamp as text, so that both engines print it alike."""
    column = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    return column.alias(name) if name else column


def sql_shown(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


def with_sql(*ctes: str, select: str, recursive: bool = False) -> str:
    """``name AS (...)`` parts and a final select as one statement."""
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + select
