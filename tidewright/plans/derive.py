"""Derived tables: a base, joined tables, per-key summaries, one final projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from tidewright.operators.aggregates import Measure, pre_aggregate
from tidewright.operators.joins import enrich, first_record
from tidewright.operators.project import final_projection
from tidewright.operators.ranking import latest_row
from tidewright.operators.reshape import pivot_join
from tidewright.specs import TableDef


@dataclass(frozen=True)
class Joined:
    """A table joined as it is, by its first record per key, or pivoted to numbered columns."""

    table: DataFrame
    alias: str
    on: dict[str, str]
    columns: Sequence[str] | None = None
    how: str = "left"
    where: str | None = None
    strategy: str = "direct"
    order_by: Sequence[str] | None = None
    pivot_value: str | None = None
    pivot_slots: int = 0


@dataclass(frozen=True)
class Summarised:
    """Measures per key, computed before the join so that the join cannot multiply rows."""

    table: DataFrame
    alias: str
    on: dict[str, str]
    measures: Sequence[Measure] = ()
    where: str | None = None


@dataclass(frozen=True)
class Newest:
    """Columns of the newest row per key."""

    table: DataFrame
    alias: str
    on: dict[str, str]
    order_by: Sequence[str]
    columns: Sequence[str] = field(default_factory=tuple)
    where: str | None = None


Step = Joined | Summarised | Newest


def attach(base: DataFrame, step: Step) -> DataFrame:
    keys = list(step.on.values())
    if isinstance(step, Summarised):
        rows = step.table.filter(step.where) if step.where else step.table
        summary = pre_aggregate(rows, keys, step.measures)
        return enrich(base, summary, step.on, step.alias, [m.name for m in step.measures])
    if isinstance(step, Newest):
        newest = latest_row(step.table, keys, step.order_by, step.columns, step.where)
        return enrich(base, newest, step.on, step.alias, step.columns)
    if step.strategy == "first_record":
        return first_record(
            base, step.table, step.on, step.alias, step.columns, step.order_by, step.how, step.where
        )
    if step.strategy == "pivot":
        rows = step.table.filter(step.where) if step.where else step.table
        return pivot_join(
            base, rows, step.on, step.pivot_value, step.pivot_slots, step.alias, step.how
        )
    return enrich(base, step.table, step.on, step.alias, step.columns, step.how, step.where)


def derive(
    base: DataFrame,
    steps: Sequence[Step],
    spec: TableDef,
    mapping: dict[str, Column],
    sort_names: bool = False,
) -> DataFrame:
    """Attach every step to the base in order, then project the target's columns."""
    rows = base
    for step in steps:
        rows = attach(rows, step)
    return final_projection(rows, spec, mapping, sort_names)
