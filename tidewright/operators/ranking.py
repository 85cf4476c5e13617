"""Top rows per key.

``row_number() <= n`` filters are planned with a partial group limit below the shuffle, so a key
that holds a large share of the rows sends only ``n`` rows per input partition.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "_tw_rank"
#: timestamps whose subsets merge_winners tries in one grouping (16 for four)
SUBSETS_UP_TO = 4
SALTS = 16


def content_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def top_n(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int = 1,
    rank: str | None = None,
) -> DataFrame:
    """The first ``n`` rows per key under ``order``; ``rank`` keeps the position as a column."""
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn(rank or _RANK, F.row_number().over(window)).filter(
        F.col(rank or _RANK) <= n
    )
    return ranked if rank else ranked.drop(_RANK)


def newest_first(df: DataFrame, order_by: Sequence[str]) -> list[Column]:
    """Descending order of the columns with the row's content as the last tiebreak.

    An entry may carry its own direction: ``"col asc"``.
    """
    out = []
    for entry in order_by:
        name, _, direction = entry.partition(" ")
        c = F.col(name)
        out.append(c.asc_nulls_last() if direction.lower() == "asc" else c.desc_nulls_last())
    return [*out, content_hash(df).asc()]


def latest(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key: the newest under ``order_by``, ties broken by content."""
    return top_n(df, keys, newest_first(df, order_by))


def latest_row(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    select: Sequence[str],
    where: str | None = None,
) -> DataFrame:
    """Filter, then keys plus selected columns of the newest row per key."""
    rows = df.filter(F.expr(where)) if where else df
    return latest(rows, keys, order_by).select(*keys, *select)


def merge_winners(
    df: DataFrame,
    keys: Sequence[str],
    stamps: dict[str, Column],
    source_index: str,
    row_index: str,
    audit: bool = False,
) -> DataFrame:
    """One winning row per key over several files; (source, row) identifies a row.

    A row scores one point for each timestamp that equals the key's maximum; the highest score
    wins, then the lowest source, then the lowest row.

    A single grouping, combined before the shuffle, finds the winner: for every subset of the timestamps
    the greatest row by these timestamps, then by place. If some row has the maxima of a whole subset,
    that greatest row is the first of them, so the largest subset for which it does holds the winner.
    Only names of rows are grouped; the join back is on (key, source, row), so a key with many rows is
    nowhere gathered. Beyond ``SUBSETS_UP_TO`` timestamps the maxima are joined to the rows, dealt over salts.
    """
    marks = [f"_tw_ts_{i}" for i in range(len(stamps))]
    staged = df.select(
        *[F.col(k).alias(f"_tw_key_{k}") for k in keys],
        (-F.col(source_index)).alias("s"),
        (-F.col(row_index)).alias("r"),
        *[c.alias(m) for c, m in zip(stamps.values(), marks)],
    )
    named = [f"_tw_key_{k}" for k in keys]
    tops = [F.max(m).alias(f"{m}_top") for m in marks]
    if len(marks) <= SUBSETS_UP_TO:
        subsets = [[m for i, m in enumerate(marks) if n >> i & 1] for n in range(2 ** len(marks))]

        def greatest(subset: list[str]) -> Column:
            return F.max(F.when(_all([F.col(m).isNotNull() for m in subset]), F.struct(*subset, "s", "r")))

        found = staged.groupBy(*named).agg(*tops, *[greatest(sub).alias(f"best{n}") for n, sub in enumerate(subsets)])
        reached = [
            F.when(_all([F.col(f"best{n}")[m] == F.col(f"{m}_top") for m in sub]),
                   F.struct(F.lit(len(sub)).alias("score"), F.col(f"best{n}.s").alias("s"), F.col(f"best{n}.r").alias("r")))
            for n, sub in enumerate(subsets)
        ]
        won = found.select(*named, (F.greatest(*reached) if len(reached) > 1 else reached[0]).alias("w"))
    else:
        salt = F.pmod(F.xxhash64("s", "r"), F.lit(SALTS))
        per_key = staged.groupBy(*named).agg(*tops).withColumn("_tw_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        per_key = per_key.select(*[F.col(k).alias(f"{k}_top") for k in named], "_tw_salt", *[f"{m}_top" for m in marks])
        same = [F.col(k).eqNullSafe(F.col(f"{k}_top")) for k in named] + [salt == F.col("_tw_salt")]
        points = [F.coalesce((F.col(m) == F.col(f"{m}_top")).cast("int"), F.lit(0)) for m in marks]
        best = F.struct(reduce(lambda a, b: a + b, points).alias("score"), "s", "r")
        won = staged.join(per_key, same).groupBy(*named).agg(F.max(best).alias("w"))
    won = won.select(*named, (-F.col("w.s")).alias("_tw_src"), (-F.col("w.r")).alias("_tw_row"), F.col("w.score").alias("merge_score"))
    match = [F.col(k).eqNullSafe(F.col(f"_tw_key_{k}")) for k in keys]
    match += [F.col(source_index) == F.col("_tw_src"), F.col(row_index) == F.col("_tw_row")]
    extra = ["merge_score"] if audit else []
    return df.join(won, match, "inner").select(*df.columns, *extra)


def _all(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def sample_rows(
    df: DataFrame, keys: Sequence[str], value: str, n: int, seed: int = 42
) -> DataFrame:
    """A reproducible sample of ``n`` rows per key: lowest seeded hash first."""
    mix = F.xxhash64(F.lit(seed), F.col(value))
    return top_n(df, keys, [mix.asc(), F.col(value).asc_nulls_last()], n)
