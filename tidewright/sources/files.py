"""Delimited, dump, JSON, Parquet and catalog sources. Delimited text always lands as strings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.sources.dialect import Delimited
from tidewright.sources.dumps import read_dump

def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    how: Delimited | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """All columns as strings. Without a header the caller names the ``columns``."""
    how = how or Delimited()
    if how.is_dump:
        return read_dump(spark, path, how, columns)
    reader = spark.read.options(**how.options())
    if columns is not None and not how.header:
        reader = reader.schema(string_schema(columns))
    return reader.csv(path)


def string_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_parquet(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.parquet(*paths)


class MissingPath(ValueError):
    """A JSON path does not exist in the source."""


def json_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Every dot path of a (nested) schema."""
    out = []
    for f in schema.fields:
        out.append(prefix + f.name)
        if isinstance(f.dataType, T.StructType):
            out += json_paths(f.dataType, f"{prefix}{f.name}.")
    return out


def project_paths(df: DataFrame, paths: dict[str, str]) -> DataFrame:
    """One flat column per dot path; a missing path is an error before anything is read."""
    known = set(json_paths(df.schema))
    missing = sorted(p for p in paths.values() if p not in known)
    if missing:
        raise MissingPath(f"no such path: {', '.join(missing)}; available: {', '.join(sorted(known))}")
    picked: list[Column] = [
        F.col(".".join(f"`{part}`" for part in path.split("."))).alias(name)
        for name, path in paths.items()
    ]
    return df.select(*picked)


def read_json(
    spark: SparkSession,
    path: str | Sequence[str],
    paths: dict[str, str],
    multiline: bool = False,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """JSON records to flat columns. A stated ``schema`` saves the pass that infers one."""
    reader = spark.read.option("multiLine", str(multiline).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return project_paths(reader.json(path), paths)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def bare_name(name: str) -> str:
    return name.replace("`", "").rsplit(".", 1)[-1]
