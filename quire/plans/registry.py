"""Registry of queries over the given tables."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}

MODULES = ["text", "retrieval", "graph", "hierarchy", "similarity", "analytics", "library", "media", "sources"]


# tables whose rows are long texts: work on them is per row and by far dearer than moving them
TEXTS = {"documents", "pages"}


def dealt_out(df: DataFrame) -> DataFrame:
    """Share out the rows of a scan that has fewer splits than the cluster has cores, as a small file of
    one row group cannot be split. A large table has many splits and is never shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@dataclass(frozen=True)
class Tables:
    """The parquet tables of one folder as DataFrames, e.g. `t.documents`."""

    spark: SparkSession
    folder: str

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        rows = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return dealt_out(rows) if name in TEXTS else rows


def query(name: str, sql: str | None = None):
    """Register a function Tables → DataFrame, with its SQL when SQL can express it."""

    def add(fn):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"quire.plans.{module}")


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn):
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _QUERIES.items()}


def oracles() -> dict[str, str]:
    _load()
    return dict(_SQL)
