"""Baselines and what changed since: row counts, distributions and single records."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.aggregates import facts_in_one_pass
from tidewright.operators.ranking import top_n

EPSILON = 1e-10
NULL_VALUE = "__NULL__"
OTHER_VALUE = "__OTHER__"
TOP_VALUES = 100


def percent_change(current: Column, previous: Column) -> Column:
    return F.when(
        previous == 0, F.when(current > 0, F.lit(100.0)).otherwise(F.lit(0.0))
    ).otherwise((current - previous) * 100.0 / previous)


def row_count_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """One row: both counts, the change and its direction."""
    n = F.count(F.lit(1))
    both = (
        baseline.agg(n.alias("n"))
        .select(F.lit("b").alias("side"), "n")
        .unionAll(current.agg(n.alias("n")).select(F.lit("c").alias("side"), "n"))
    )
    counts = both.agg(
        F.max(F.when(F.col("side") == "b", F.col("n"))).alias("previous_count"),
        F.max(F.when(F.col("side") == "c", F.col("n"))).alias("current_count"),
    )
    change = F.col("current_count") - F.col("previous_count")
    return counts.select(
        "previous_count",
        "current_count",
        change.alias("absolute_change"),
        F.round(percent_change(F.col("current_count"), F.col("previous_count")), 6).alias(
            "percent_change"
        ),
        F.when(change > 0, "increase")
        .when(change < 0, "decrease")
        .otherwise("unchanged")
        .alias("direction"),
    )


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value) of every cell; a NULL stays one, whatever texts the data holds."""
    cast = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return cast.unpivot([], list(columns), "column_name", "value")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per value of every column, all columns in one grouped pass."""
    return cells(df, columns).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(counts: DataFrame, top: int = TOP_VALUES) -> DataFrame:
    """The most frequent values per column (kind ``value``, or ``null`` for NULLs); the rest is one row of kind ``other``.

    NULLs show as ``__NULL__`` and the rest as ``__OTHER__``; the kind tells them from texts spelled so.
    """
    order = [F.col("n").desc(), F.col("value").asc()]
    kept = top_n(counts, ["column_name"], order, top)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    # both sides are bounded: at most ``top`` rows, and one row, per column
    rest = (
        kept.groupBy("column_name")
        .agg(F.sum("n").alias("kept"))
        .join(totals, "column_name")
        .filter(F.col("total") > F.col("kept"))
        .select(
            "column_name",
            F.lit(OTHER_VALUE).alias("value"),
            (F.col("total") - F.col("kept")).alias("n"),
            F.lit("other").alias("kind"),
        )
    )
    kind = F.when(F.col("value").isNull(), "null").otherwise("value")
    shown = F.coalesce("value", F.lit(NULL_VALUE))
    return kept.select("column_name", shown.alias("value"), "n", kind.alias("kind")).unionAll(rest)


def distribution(df: DataFrame, columns: Sequence[str], top: int = TOP_VALUES) -> DataFrame:
    return top_values(value_counts(df, columns), top)


def count_facts(counts: DataFrame) -> DataFrame:
    """Per column: rows, distinct non-null values and NULLs."""
    is_null = F.col("value").isNull()
    return counts.groupBy("column_name").agg(
        F.sum("n").alias("total_count"),
        F.count_if(~is_null).alias("distinct_count"),
        F.coalesce(F.sum(F.when(is_null, F.col("n"))), F.lit(0)).alias("null_count"),
    )


def distribution_facts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return count_facts(value_counts(df, columns))


def numeric_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]


def numeric_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """min, max, mean and sample standard deviation, all columns in one aggregate."""
    columns = list(columns or numeric_columns(df.schema))
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
            F.avg(F.col(c).cast("double")).alias("mean"),
            F.stddev_samp(F.col(c).cast("double")).alias("stddev"),
        )
        for c in columns
    ]
    return facts_in_one_pass(df, rows)


def low_cardinality_columns(df: DataFrame, most: int = 100) -> list[str]:
    """Text columns with at most ``most`` distinct values, told exactly by one aggregate of bounded sketches.

    A theta sketch keeps the smallest hashes of a column and is exact until it is full, so each column sends some
    ``2 * most`` hashes per task at most, however many values it has.
    """
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text:
        return []
    size = max(8, (2 * most).bit_length())
    counts = df.agg(F.array(*[F.theta_sketch_estimate(F.theta_sketch_agg(F.col(f"`{c}`"), size)) for c in text])).first()[0]
    return [c for c, n in zip(text, counts, strict=True) if n <= most]


def record_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    """Content hash of a record; the position of a NULL is part of the content."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def record_checksums(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """One row per record: its key columns and its checksum. ``meta_checksum`` is used if present."""
    if "meta_checksum" in df.columns:
        return df.select(*keys, F.col("meta_checksum").alias("checksum"))
    chosen = columns or [c for c in df.columns if not c.startswith("meta_") and c not in keys]
    return df.select(*keys, record_hash(df, list(chosen)).alias("checksum"))


def _counts_side(df: DataFrame, columns: Sequence[str], baseline: bool) -> DataFrame:
    n = F.col("n")
    zero = F.lit(0).cast("bigint")
    return value_counts(df, columns).select(
        "column_name",
        "value",
        (n if baseline else zero).alias("b"),
        (zero if baseline else n).alias("c"),
    )


def paired_counts(baseline: DataFrame, current: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts of every (column, value) on both sides, by one grouped union instead of a join."""
    return (
        _counts_side(baseline, columns, True)
        .unionAll(_counts_side(current, columns, False))
        .groupBy("column_name", "value")
        .agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    )


def distribution_drift(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Jensen-Shannon divergence (base 2) per column, with distinct, new and removed counts.

    A value missing on one side weighs ``EPSILON`` there and each side is then normalised, so the
    sums run over all values of a column with totals that are themselves sums: two passes over the
    grouped counts, and a join with one row per column, broadcast as the schema bounds it.
    """
    pairs = paired_counts(baseline, current, columns)
    totals = pairs.groupBy("column_name").agg(
        F.sum("b").alias("b_total"),
        F.sum("c").alias("c_total"),
        F.count_if(F.col("b") == 0).alias("b_missing"),
        F.count_if(F.col("c") == 0).alias("c_missing"),
    )
    joined = pairs.join(F.broadcast(totals), "column_name")

    def share(n: str) -> Column:
        total, missing = F.col(f"{n}_total"), F.col(f"{n}_missing")
        some = F.when(total > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        raw = F.when(F.col(n) > 0, F.col(n) / total).otherwise(F.lit(EPSILON))
        return raw / (some + missing * EPSILON)

    p, q = share("b"), share("c")
    m = (p + q) / 2
    term = p * F.ln(p / m) + q * F.ln(q / m)
    divergence = F.sum(term) / 2 / math.log(2)
    not_null = F.col("value").isNotNull()
    return joined.groupBy("column_name").agg(
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence)), 6).alias("js_divergence"),
        F.count_if((F.col("b") > 0) & not_null).alias("previous_distinct"),
        F.count_if((F.col("c") > 0) & not_null).alias("current_distinct"),
        F.count_if((F.col("b") == 0) & not_null).alias("new_values"),
        F.count_if((F.col("c") == 0) & not_null).alias("removed_values"),
    )


def changed_values(
    baseline: DataFrame, current: DataFrame, columns: Sequence[str], n: int = 10
) -> DataFrame:
    """The most frequent new and removed values per column, at most ``n`` of each."""
    pairs = paired_counts(baseline, current, columns).filter(F.col("value").isNotNull())
    gone = pairs.filter((F.col("b") == 0) | (F.col("c") == 0)).select(
        "column_name",
        F.when(F.col("b") == 0, "new").otherwise("removed").alias("change"),
        "value",
        (F.col("b") + F.col("c")).alias("row_count"),
    )
    order = [F.col("row_count").desc(), F.col("value").asc()]
    return top_n(gone, ["column_name", "change"], order, n)


def reconcile(
    baseline: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Every key with its change: added, removed, modified or unchanged."""
    shared = columns or [
        c
        for c in baseline.columns
        if c in current.columns and c not in keys and not c.startswith("meta_")
    ]
    old = record_checksums(baseline, keys, shared).withColumnRenamed("checksum", "was")
    new = record_checksums(current, keys, shared).withColumnRenamed("checksum", "now")
    joined = old.join(new, list(keys), "full_outer")
    change = (
        F.when(F.col("was").isNull(), "added")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("was") != F.col("now"), "modified")
        .otherwise("unchanged")
    )
    return joined.select(*keys, change.alias("change"))


def record_summary(
    baseline: DataFrame,
    current: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """One row: counts per kind of change; added relative to current, the others to baseline."""
    changes = reconcile(baseline, current, keys, columns)
    counts = changes.agg(
        *[
            F.count_if(F.col("change") == kind).alias(f"{kind}_count")
            for kind in ("added", "removed", "modified", "unchanged")
        ]
    )
    kept = F.col("modified_count") + F.col("unchanged_count")

    def percent(part: str, total: Column) -> Column:
        share = F.round(F.col(f"{part}_count") * 100.0 / F.nullif(total, F.lit(0)), 6)
        return F.coalesce(share, F.lit(0.0)).alias(f"{part}_percent")

    before, after = kept + F.col("removed_count"), kept + F.col("added_count")
    return counts.select(
        "*", percent("added", after), percent("removed", before), percent("modified", before)
    )


def capture_baseline(
    df: DataFrame,
    path: str,
    table: str,
    pipeline: str,
    run_timestamp: str,
    run_id: str,
    keys: Sequence[str] = (),
    columns: Sequence[str] | None = None,
) -> None:
    """Write a run's baseline as rows: sizes, numeric statistics, distributions, checksums.

    The table is read once for each kind. Value counts are written first; the distribution and its
    facts are derived from those few rows.
    """
    spark = df.sparkSession
    tags = {
        "table_name": F.lit(table),
        "pipeline": F.lit(pipeline),
        "run_id": F.lit(run_id),
        "run_timestamp": F.lit(run_timestamp).cast("timestamp_ntz"),
    }

    def keep(part: DataFrame, name: str) -> None:
        part.withColumns(tags).write.mode("append").partitionBy("table_name").parquet(
            f"{path}/{name}"
        )

    tracked = list(columns or low_cardinality_columns(df))
    numeric = numeric_columns(df.schema)
    if numeric:
        keep(numeric_stats(df, numeric), "numeric")
    keep(df.agg(F.count(F.lit(1)).alias("row_count")), "rows")
    if tracked:
        keep(value_counts(df, tracked), "counts")
        mine = spark.read.parquet(f"{path}/counts").filter(
            (F.col("table_name") == table) & (F.col("pipeline") == pipeline) & (F.col("run_id") == run_id)
        )
        counts = mine.select("column_name", "value", "n")
        keep(top_values(counts), "distribution")
        keep(count_facts(counts), "facts")
    if keys:
        keep(record_checksums(df, keys), "records")
