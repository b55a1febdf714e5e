"""Registered queries: each runs a library operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from assayline.sources.readers import read_split

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name`` with its check SQL, if any."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """Text table for work that is heavy per row: a table of few partitions is spread."""
    return read_split(spark, f"{sf_dir}/{name}.parquet", spread=True)


MODULES = [
    "cleaning",
    "joining",
    "selection",
    "voting",
    "measures",
    "transport",
    "reshaping",
    "answers",
    "statistics",
    "choice_scores",
    "text_scores",
    "statistics",
    "flows",
]


def load_all() -> None:
    from importlib import import_module

    for name in MODULES:
        import_module(f"assayline.queries.{name}")
