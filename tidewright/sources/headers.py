"""Delivered headers to declared columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.specs import TableDef


class MissingColumns(ValueError):
    """Required columns were not delivered."""


def _fold(name: str) -> str:
    return name.strip().casefold()


def known_names(spec: TableDef) -> dict[str, str]:
    """Folded name to column: names claim first, then canonical names, then aliases."""
    known: dict[str, str] = {}
    for c in spec.columns:
        known.setdefault(_fold(c.name), c.name)
    for c in spec.columns:
        if c.canonical:
            known.setdefault(_fold(c.canonical), c.name)
    for c in spec.columns:
        for alias in c.aliases:
            known.setdefault(_fold(alias), c.name)
    return known


def header_mapping(headers: Sequence[str], spec: TableDef) -> dict[str, str]:
    """Column to the delivered header that supplies it; of two equal headers the first counts."""
    known, taken = known_names(spec), {}
    for header in headers:
        column = known.get(_fold(header))
        if column is not None:
            taken.setdefault(column, header)
    return taken


def resolve_headers(df: DataFrame, spec: TableDef, keep: Sequence[str] = ()) -> DataFrame:
    """Declared columns in declared order; unknown headers are left out.

    A missing optional column becomes a NULL string, a missing required one is an error.
    """
    taken = header_mapping([c for c in df.columns if c not in keep], spec)
    missing = [c.name for c in spec.columns if c.required and c.name not in taken and not c.expression]
    if missing:
        raise MissingColumns(f"{spec.name}: required columns not delivered: {', '.join(missing)}")
    out = [
        F.col(f"`{taken[c.name]}`").alias(c.name)
        if c.name in taken
        else F.lit(None).cast("string").alias(c.name)
        for c in spec.columns
        if not c.expression or c.name in taken
    ]
    return df.select(*out, *keep)
