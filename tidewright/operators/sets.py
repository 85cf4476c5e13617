"""Key universes, unions by name and set differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.aggregates import facts_in_one_pass


def key_universe(sources: Sequence[tuple[DataFrame, str]], key: str) -> DataFrame:
    """Every distinct non-null key of any source.

    Each source is made distinct before the union, so a hot key is dropped on the map side.
    """
    parts = [df.select(F.col(c).alias(key)).filter(F.col(key).isNotNull()) for df, c in sources]
    return reduce(lambda a, b: a.unionAll(b), parts).distinct()


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def value_difference(baseline: DataFrame, current: DataFrame, column: str) -> DataFrame:
    """Values that are new in ``current`` or gone from ``baseline``."""
    seen = (
        baseline.select(F.col(column).alias("value"), F.lit(1).alias("b"), F.lit(0).alias("c"))
        .unionAll(current.select(F.col(column), F.lit(0), F.lit(1)))
        .filter(F.col("value").isNotNull())
        .groupBy("value")
        .agg(F.max("b").alias("b"), F.max("c").alias("c"))
    )
    return seen.filter(F.col("b") != F.col("c")).select(
        "value", F.when(F.col("c") == 1, "new").otherwise("removed").alias("change")
    )


def column_difference(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Missing columns as errors, unexpected ones as warnings with the values they hold."""
    text = T.StringType()
    schema = T.StructType(
        [T.StructField(n, text) for n in ("column_name", "finding", "severity")]
        + [T.StructField("value_count", T.LongType())]
    )
    missing = [(c, "missing", "error", None) for c in expected if c not in df.columns]
    findings = df.sparkSession.createDataFrame(missing, schema)
    unexpected = [c for c in df.columns if c not in expected]
    if not unexpected:
        return findings
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit("unexpected").alias("finding"),
            F.lit("warning").alias("severity"),
            F.count(f"`{c}`").alias("value_count"),
        )
        for c in unexpected
    ]
    return findings.unionAll(facts_in_one_pass(df, rows))
