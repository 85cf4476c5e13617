"""Row scopes: keys, cutoffs, exclusions and flags before and after an upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(keys))


def scoped_counts(df: DataFrame, scopes: dict[str, str]) -> DataFrame:
    """Rows in each named scope, all scopes in one pass."""
    rows = [
        F.struct(F.lit(n).alias("scope"), F.count_if(F.expr(w)).alias("row_count"))
        for n, w in scopes.items()
    ]
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def since(df: DataFrame, cutoff: Column | str, column: str = "meta_load_dt") -> DataFrame:
    """Rows loaded after the cutoff; a NULL load time is never inside the window."""
    bound = F.lit(cutoff) if isinstance(cutoff, str) else cutoff
    return df.filter(F.col(column) > bound)


def exclude_matching(
    df: DataFrame, other: DataFrame, on: dict[str, str], exclude_when: str
) -> DataFrame:
    """Drop the rows that find a row in ``other`` for which ``exclude_when`` holds.

    The condition reads the other table's columns; it is applied there first, so only the keys
    that exclude something reach the join.
    """
    banned = other.filter(F.expr(exclude_when)).select(
        *[F.col(o).alias(f"_tw_{o}") for o in on.values()]
    )
    return df.join(banned, [F.col(b) == F.col(f"_tw_{o}") for b, o in on.items()], "left_anti")


def flag_rows(df: DataFrame, flag: str, value: object, when: str) -> DataFrame:
    """Set ``flag`` to ``value`` where the condition holds; other rows keep what they had."""
    current = F.col(flag) if flag in df.columns else F.lit(None)
    return df.withColumn(flag, F.when(F.expr(when), F.lit(value)).otherwise(current))


def flag_matching(
    df: DataFrame, other: DataFrame, on: dict[str, str], flag: str, value: object, when: str
) -> DataFrame:
    """Set ``flag`` where a row of ``other`` with the same key satisfies ``when``."""
    hits = (
        other.filter(F.expr(when))
        .select(*[F.col(o).alias(f"_tw_{o}") for o in on.values()])
        .distinct()
        .withColumn("_tw_hit", F.lit(True))
    )
    joined = df.join(hits, [F.col(b) == F.col(f"_tw_{o}") for b, o in on.items()], "left")
    current = F.col(flag) if flag in df.columns else F.lit(None)
    marked = joined.withColumn(flag, F.when(F.col("_tw_hit"), F.lit(value)).otherwise(current))
    return marked.select(*df.columns, *([] if flag in df.columns else [flag]))
