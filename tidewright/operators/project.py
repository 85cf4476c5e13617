"""Output projections: derived columns, defaults, value maps, provenance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.specs import TableDef


def required_columns(df: DataFrame, used: Sequence[str], key: str | None = None) -> DataFrame:
    """Only the columns a derivation uses, the key and the provenance; none used means all."""
    if not used:
        return df
    wanted = dict.fromkeys([*([key] if key else []), *used])
    kept = [c for c in df.columns if c in wanted or c.startswith("meta_")]
    return df.select(*kept)


def override(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Replace columns in place by expressions over the input; new names are added at the end."""
    kept = [
        F.expr(expressions[c]).alias(c) if c in expressions else F.col(c) for c in df.columns
    ]
    added = [F.expr(e).alias(c) for c, e in expressions.items() if c not in df.columns]
    return df.select(*kept, *added)


def final_projection(
    df: DataFrame,
    spec: TableDef,
    mapping: dict[str, Column],
    sort_names: bool = False,
) -> DataFrame:
    """The target's columns: mapped expression, else typed default, else typed NULL.

    Provenance columns of every joined instance (``alias__meta_*``) pass through.
    """
    columns = list(spec.columns)
    if sort_names:
        columns.sort(key=lambda c: c.name.lower())
    out = []
    for c in columns:
        if c.name in mapping:
            out.append(mapping[c.name].cast(c.spark_type).alias(c.name))
        else:
            out.append(F.lit(c.default).cast(c.spark_type).alias(c.name))
    provenance = [
        F.col(c) for c in df.columns if c.startswith("meta_") or "__meta_" in c
    ]
    return df.select(*out, *provenance)


def null_literals(
    df: DataFrame, columns: Sequence[str] | None = None, preserve: Sequence[str] = ()
) -> DataFrame:
    """The text NULL, in any case, becomes a real NULL unless the column preserves it."""
    text = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType)
        and (columns is None or f.name in columns)
        and f.name not in preserve
    ]
    return df.withColumns(
        {c: F.when(F.upper(F.trim(c)) != "NULL", F.col(c)) for c in text} if text else {}
    )


def map_values(c: Column, mapping: dict[str, str], otherwise: Column | None = None) -> Column:
    """Replace values by a fixed map; unmapped values become ``otherwise`` (default NULL)."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.try_element_at(F.create_map(*pairs), c)
    return found if otherwise is None else F.coalesce(found, otherwise)


def pass_provenance(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("meta_") or "__meta_" in c]
