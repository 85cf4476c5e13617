"""Rows to numbered columns and columns to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators.joins import enrich
from tidewright.operators.ranking import newest_first, top_n


def pivot_ranked(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    n: int,
    prefix: str,
    order: Sequence[Column] | None = None,
) -> DataFrame:
    """The first ``n`` values per key, ascending with NULL last, as ``<prefix>_1..n``."""
    order = list(order) if order else [F.col(value).asc_nulls_last()]
    ranked = top_n(df.select(*dict.fromkeys([*keys, value])) if len(order) == 1 else df,
                   keys, order, n, rank="_tw_pos")
    slots = [
        F.max(F.when(F.col("_tw_pos") == i, F.col(value))).alias(f"{prefix}_{i}")
        for i in range(1, n + 1)
    ]
    return ranked.groupBy(*keys).agg(*slots)


def pivot_join(
    base: DataFrame,
    other: DataFrame,
    on: dict[str, str],
    value: str,
    n: int,
    prefix: str,
    how: str = "left",
) -> DataFrame:
    keys = list(on.values())
    wide = pivot_ranked(other, keys, value, n, prefix)
    slots = [f"{prefix}_{i}" for i in range(1, n + 1)]
    joined = enrich(base, wide, on, "_tw", slots, how)
    return joined.withColumnsRenamed({f"_tw__{s}": s for s in slots})


def unpivot_columns(
    df: DataFrame,
    ids: Sequence[str],
    columns: Sequence[str],
    name: str = "source_column",
    value: str = "value",
) -> DataFrame:
    """One row per non-null cell."""
    return df.unpivot(list(ids), list(columns), name, value).filter(F.col(value).isNotNull())


def unpivot_latest(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    snapshot: str,
    name: str = "source_column",
    value: str = "value",
) -> DataFrame:
    """Newest snapshot row per key first, so all cells come from the winner; then unpivot."""
    newest = top_n(df, keys, newest_first(df, [snapshot]))
    return unpivot_columns(newest, keys, columns, name, value)
