"""The registered queries and the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayledger.sources.fixtures import Tables, with_views

Build = Callable[[Tables], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The check SQL as written, without the views of the domain tables.
UNWRAPPED: dict[str, str] = {}


def query(key: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register a query under ``key``; without ``sql`` it is covered by the tests alone."""

    def add(build: Build) -> Build:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return build(Tables(spark, folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
            UNWRAPPED[key] = sql
        return build

    return add
