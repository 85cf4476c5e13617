"""Registered queries: each name has a Spark job and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

MODULES = (
    "ingest",
    "casting",
    "joining",
    "reshaping",
    "filtering",
    "checking",
    "drifting",
    "profiles",
    "catalogs",
    "corpora",
    "files",
    "generated",
    "streams",
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    covers: tuple[str, ...]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, covers: str, oracle: str | None = None):
    """Register ``fn(t)`` (``t`` reads the given tables) as the query ``name``."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        if name in REGISTRY:
            raise ValueError(f"query {name!r} registered twice")
        REGISTRY[name] = Query(name, run, tuple(covers.split()), oracle)
        return fn

    return register


class Tables:
    """The given tables, read lazily: ``t.orders`` is a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self.read: dict[str, DataFrame] = {}

    def path(self, table: str) -> str:
        return f"{self.dir}/{table}.parquet"

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        if table not in self.read:
            self.read[table] = self.spark.read.parquet(self.path(table))
        return self.read[table]


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"{__name__}.{module}")
    return REGISTRY
