"""Per-key aggregation ahead of joins."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def facts_in_one_pass(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Aggregate structs as rows, by a single aggregation over ``df`` however many they are.

    Code generated for very many aggregates is too long to be compiled well; sessions should set
    ``spark.sql.codegen.hugeMethodLimit`` to 8000, so that Spark takes its split form of such code instead.
    """
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


@dataclass(frozen=True)
class Measure:
    """A named aggregate, used exactly as written, over the rows that pass ``where``."""

    name: str
    expression: str
    where: str | None = None


SINGLE_CALL = re.compile(r"\s*\w+\s*\([^()]*(\([^()]*\)[^()]*)*\)\s*")


def _filtered(m: Measure) -> Column:
    """The measure over the rows its filter admits; NULL where a group has none."""
    if m.where is None:
        return F.expr(m.expression).alias(m.name)
    admitted = F.expr(f"count_if({m.where})") > 0
    return F.when(admitted, F.expr(f"{m.expression} FILTER (WHERE {m.where})")).alias(m.name)


def pre_aggregate(df: DataFrame, keys: Sequence[str], measures: Sequence[Measure]) -> DataFrame:
    """One row per key (NULL keys are a group) that some filter admits, with every measure.

    Filters belong to their measures, so the source is read and shuffled once. A measure made of
    several calls cannot carry a filter; such measures are aggregated over their filtered rows and
    the parts are brought together by a second grouping.
    """
    apart: dict[str, list[Measure]] = {}
    plain = []
    for m in measures:
        if m.where is not None and not SINGLE_CALL.fullmatch(m.expression):
            apart.setdefault(m.where, []).append(m)
        else:
            plain.append(m)
    parts = []
    if plain:
        rows = df
        if all(m.where is not None for m in plain):
            rows = df.filter(" OR ".join(f"({w})" for w in dict.fromkeys(m.where for m in plain)))
        parts.append(rows.groupBy(*keys).agg(*[_filtered(m) for m in plain]))
    for where, group in apart.items():
        aggregates = [F.expr(m.expression).alias(m.name) for m in group]
        parts.append(df.filter(F.expr(where)).groupBy(*keys).agg(*aggregates))
    names = [m.name for m in measures]
    if len(parts) == 1:
        return parts[0].select(*keys, *names)
    united = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return united.groupBy(*keys).agg(*[F.first(n, ignorenulls=True).alias(n) for n in names])


def distinct_tuples(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: rows, distinct tuples (NULL counts as a value) and whether they are equal."""
    groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_count"),
    ).withColumn("is_unique", F.col("row_count") == F.col("distinct_count"))


def duplicate_groups(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The tuples that occur more than once, with their sizes."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")


def duplicate_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return duplicate_groups(df, columns).agg(
        F.count(F.lit(1)).alias("duplicate_groups"),
        F.coalesce(F.sum("group_size"), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.max("group_size"), F.lit(0)).alias("largest_group"),
    )
