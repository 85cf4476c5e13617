"""Typed columns to output text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.formats import java_pattern
from tidewright.specs import TableDef


def format_outputs(df: DataFrame, spec: TableDef) -> DataFrame:
    """Date and time columns that declare a format become text in that format."""
    temporal = (T.DateType, T.TimestampType, T.TimestampNTZType)
    shown = {}
    for c in spec.columns:
        if c.format and c.name in df.columns and isinstance(df.schema[c.name].dataType, temporal):
            shown[c.name] = F.date_format(c.name, java_pattern(c.format))
    return df.withColumns(shown)


def render_nulls(df: DataFrame, spec: TableDef) -> DataFrame:
    """NULL becomes the column's declared output text; runs after the formatting."""
    shown = {
        c.name: F.coalesce(F.col(c.name).cast("string"), F.lit(c.null_output))
        for c in spec.columns
        if c.null_output is not None and c.name in df.columns
    }
    return df.withColumns(shown)
