"""Raw rows to a typed, deduplicated table; batch after batch."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions.casts import cast_table
from tidewright.operators.ranking import latest
from tidewright.specs import TableDef


def typed_batch(raw: DataFrame, spec: TableDef, native: bool | None = None) -> DataFrame:
    """Cast one raw batch; a keyed incremental table also keeps only the newest row per key.

    Order columns that are not part of the table (such as the load time) are used and dropped.
    """
    order = [o.partition(" ")[0] for o in spec.order_by]
    outside = tuple(
        o for o in order if o in raw.columns and o not in {c.name for c in spec.columns}
    )
    rows = cast_table(raw, spec, keep=outside, native=native)
    if spec.mode == "incremental" and spec.primary_key:
        usable = [o for o in spec.order_by if o.partition(" ")[0] in rows.columns]
        rows = latest(rows, spec.primary_key, usable)
    return rows.drop(*outside)


def upsert_last_batch(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The batch replaces target rows with the same key, whatever their age; all rows of the batch come in.

    Both sides are read once and resolved by one ranking per key, whose limit lies below the shuffle. Rows with a NULL in
    their key replace nothing and are not replaced.
    """
    sides = [df.withColumn("_tw_side", F.lit(i)) for i, df in enumerate((target, batch))]
    rows = sides[0].unionByName(sides[1])
    keyless = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    own = F.when(keyless, F.col("_tw_side"))
    newest = F.rank().over(Window.partitionBy(*keys, own).orderBy(F.col("_tw_side").desc()))
    return rows.withColumn("_tw_rank", newest).filter("_tw_rank = 1").drop("_tw_rank", "_tw_side")


def upsert_newest(
    target: DataFrame, batch: DataFrame, keys: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """The newest row per key survives, in whatever order the batches arrive."""
    return latest(target.unionByName(batch), keys, order_by)


def apply_batches(
    batches: Iterable[DataFrame],
    keys: Sequence[str],
    order_by: Sequence[str],
    guard: str = "last_batch",
) -> DataFrame:
    """Result of applying the batches in turn: ``last_batch`` or ``newest`` wins per key.

    The batches are tagged and resolved by one ranking, not by one join per batch.
    """
    if guard not in ("last_batch", "newest"):
        raise ValueError(f"unknown guard {guard!r}")
    tagged = [b.withColumn("_tw_batch", F.lit(i)) for i, b in enumerate(batches)]
    rows = reduce(lambda a, b: a.unionByName(b), tagged)
    order = (["_tw_batch"] if guard == "last_batch" else []) + list(order_by)
    return latest(rows, keys, order).drop("_tw_batch")


def snapshot_latest(raw: DataFrame, order_by: str) -> DataFrame:
    """Only the rows of the newest delivery: those with the greatest order value."""
    newest = raw.agg(F.max(order_by).alias("_tw_newest"))
    return raw.join(newest, F.col(order_by) == F.col("_tw_newest"), "left_semi")
