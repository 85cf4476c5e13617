"""Canonical text of values, and proofs that two tables hold the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(c: Column, dtype: T.DataType, digits: int = 6) -> Column:
    """A value as comparable text: NULL spelled out, times cut (not rounded) to ``digits``."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(c, "true").otherwise("false")
        text = F.when(c.isNotNull(), text)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        fraction = F.substr(F.date_format(c, "SSSSSS"), F.lit(1), F.lit(digits))
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        if digits:
            text = F.concat(text, F.lit("."), fraction)
        if isinstance(dtype, T.TimestampType):
            text = F.concat(text, F.lit("Z"))
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(c)
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL"))


def canonical_rows(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every column as canonical text, names in order."""
    return df.select(
        *[
            canonical(F.col(f"`{f.name}`"), f.dataType, digits).alias(f.name)
            for f in sorted(df.schema.fields, key=lambda f: f.name)
        ]
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that depends on the rows but not on their order or partitioning."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in canonical_rows(df).columns])
    return canonical_rows(df).select(h.alias("h")).agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum_hash"),
    )


def row_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows (as canonical text) that one side holds more often, with the surplus of the left.

    Both sides are counted by row in one grouped union, so repeated rows meet as counts.
    """
    a, b = canonical_rows(left), canonical_rows(right)
    if a.columns != b.columns:
        raise ValueError(f"columns differ: {a.columns} and {b.columns}")
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(-1)))
    return (
        both.groupBy(*a.columns)
        .agg(F.sum("_side").alias("surplus"))
        .filter("surplus <> 0")
    )
