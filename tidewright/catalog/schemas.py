"""Schemas as data: column facts of many tables, their differences and how grave those are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.aggregates import facts_in_one_pass
from tidewright.specs import TableDef

# Type changes that lose nothing, as (from, to).
SAFE_WIDENINGS = (
    ("INTEGER", "DECIMAL"),
    ("INTEGER", "FLOAT"),
    ("CHAR", "VARCHAR"),
    ("CHAR", "TEXT"),
    ("VARCHAR", "TEXT"),
    ("DATE", "DATETIME"),
    ("DATE", "TIMESTAMP"),
    ("DATETIME", "TIMESTAMP"),
)

FACT_SCHEMA = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("position", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("length", T.IntegerType()),
        T.StructField("precision", T.IntegerType()),
        T.StructField("scale", T.IntegerType()),
        T.StructField("dimension", T.IntegerType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("description", T.StringType()),
        T.StructField("key_position", T.IntegerType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
    ]
)
COMPARED = ("type", "length", "precision", "scale", "dimension", "nullable", "description")


def column_facts(spark: SparkSession, specs: Sequence[TableDef]) -> DataFrame:
    """One row per column of every table."""
    rows = []
    for spec in specs:
        for i, c in enumerate(spec.columns):
            decimal = c.kind == "DECIMAL"
            key = spec.primary_key.index(c.name) if c.name in spec.primary_key else None
            rows.append(
                (spec.name, c.name, i, c.kind, c.length, c.precision if decimal else None,
                 c.scale if decimal else None, c.dimension, not c.required, c.description, key,
                 list(c.aliases))
            )
    return spark.createDataFrame(rows, FACT_SCHEMA)


def value_counts_of(df: DataFrame, table: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-null values per column of a table: what a change of that column would touch."""
    rows = [
        F.struct(
            F.lit(table).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.count(f"`{c}`").alias("value_count"),
        )
        for c in (columns or df.columns)
    ]
    return facts_in_one_pass(df, rows)


def _side(facts: DataFrame, prefix: str) -> DataFrame:
    plain = [c for c in facts.columns if c not in ("table_name", "column_name")]
    return facts.select(
        "table_name", "column_name", F.lit(True).alias(f"{prefix}_here"),
        *[F.col(c).alias(f"{prefix}_{c}") for c in plain],
    )


def pair_up(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns of both states side by side; a column renamed through an alias is one pair."""
    renamed = (
        new.select("table_name", F.col("column_name").alias("now"), F.explode("aliases").alias("was"))
        .join(
            old.select("table_name", F.col("column_name").alias("was")), ["table_name", "was"], "left_semi"
        )
        .join(
            new.select("table_name", F.col("column_name").alias("was")), ["table_name", "was"], "left_anti"
        )
        .join(
            old.select("table_name", F.col("column_name").alias("now")), ["table_name", "now"], "left_anti"
        )
        .groupBy("table_name", "was")
        .agg(F.min("now").alias("now"))
    )
    before = (
        old.join(
            renamed.withColumnRenamed("was", "column_name"), ["table_name", "column_name"], "left"
        )
        .withColumn("old_name", F.col("column_name"))
        .withColumn("column_name", F.coalesce("now", "column_name"))
        .drop("now")
    )
    return _side(before, "old").join(_side(new, "new"), ["table_name", "column_name"], "full_outer")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Removed, modified, renamed and added columns with the fields that changed."""
    pairs = pair_up(old, new)
    changed = F.array_compact(
        F.array(
            *[
                F.when(~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")), F.lit(c))
                for c in COMPARED
            ]
        )
    )
    renamed = F.col("old_old_name") != F.col("column_name")
    change = (
        F.when(F.col("new_here").isNull(), "removed")
        .when(F.col("old_here").isNull(), "added")
        .when(renamed, "renamed")
        .when(F.size(changed) > 0, "modified")
    )
    rank = F.array_position(
        F.array(*[F.lit(x) for x in ("removed", "renamed", "modified", "added")]), F.col("change")
    )
    return (
        pairs.select(
            "*",
            change.alias("change"),
            F.when(F.col("old_here") & F.col("new_here"), F.array_join(changed, ",")).alias(
                "changed_fields"
            ),
        )
        .filter(F.col("change").isNotNull())
        .withColumn("change_order", rank)
    )


def _is_safe(old: Column, new: Column) -> Column:
    safe = F.lit(False)
    for before, after in SAFE_WIDENINGS:
        safe = safe | ((old == before) & (new == after))
    return safe


def _wide_enough(old: Column, new: Column, unbounded_is_wider: bool = True) -> Column:
    """``new`` holds everything ``old`` held; no limit at all is the widest."""
    return new.isNull() | F.coalesce(new >= old, F.lit(False))


def classify(diff: DataFrame) -> DataFrame:
    """One row per finding: what changed and whether readers break, are warned, or are informed."""
    c = F.col
    old_type, new_type = c("old_type"), c("new_type")
    both = c("old_here") & c("new_here")
    same_type = both & (old_type == new_type)
    length_ok = _wide_enough(c("old_length"), c("new_length"))
    number_ok = _wide_enough(c("old_precision"), c("new_precision")) & _wide_enough(
        c("old_scale"), c("new_scale")
    )
    number_changed = ~(
        c("old_precision").eqNullSafe(c("new_precision")) & c("old_scale").eqNullSafe(c("new_scale"))
    )
    sized = old_type.isin("VARCHAR", "CHAR")

    def finding(when: Column, name: str, severity: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("finding"), F.lit(severity).alias("severity")))

    new_sizes = ~c("old_length").eqNullSafe(c("new_length"))
    findings = [
        finding(c("change") == "removed", "removed", "breaking"),
        finding((c("change") == "added") & c("new_nullable"), "added", "info"),
        finding((c("change") == "added") & ~c("new_nullable"), "added_required", "breaking"),
        finding(c("change") == "renamed", "renamed", "info"),
        finding(both & (old_type != new_type) & _is_safe(old_type, new_type), "type_widened", "info"),
        finding(
            both & (old_type != new_type) & ~_is_safe(old_type, new_type), "type_narrowed", "breaking"
        ),
        finding(same_type & sized & new_sizes & length_ok, "length_widened", "info"),
        finding(same_type & sized & new_sizes & ~length_ok, "length_narrowed", "breaking"),
        finding(same_type & (old_type == "DECIMAL") & number_changed & number_ok,
                "precision_widened", "info"),
        finding(same_type & (old_type == "DECIMAL") & number_changed & ~number_ok,
                "precision_narrowed", "breaking"),
        finding(
            same_type & (old_type == "EMBEDDING") & ~c("old_dimension").eqNullSafe(c("new_dimension")),
            "dimension_changed",
            "breaking",
        ),
        finding(both & c("old_nullable") & ~c("new_nullable"), "nullable_tightened", "breaking"),
        finding(both & ~c("old_nullable") & c("new_nullable"), "nullable_relaxed", "info"),
        finding(
            both & ~c("old_description").eqNullSafe(c("new_description")),
            "description_changed",
            "info",
        ),
    ]
    return (
        diff.select(
            "table_name", "column_name", "change", "change_order",
            F.explode(F.array_compact(F.array(*findings))).alias("f"),
        )
        .select("table_name", "column_name", "change", "f.finding", "f.severity", "change_order")
        .orderBy("table_name", "change_order", "column_name", "finding")
        .drop("change_order")
    )


def key_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Primary keys that were added (warning), removed or changed (breaking)."""

    def key(facts: DataFrame, name: str) -> DataFrame:
        held = F.when(F.col("key_position").isNotNull(), F.struct("key_position", "column_name"))
        columns = F.transform(F.array_sort(F.collect_list(held)), lambda s: s["column_name"])
        return facts.groupBy("table_name").agg(F.array_join(columns, ",").alias(name))

    both = key(old, "old_key").join(key(new, "new_key"), "table_name")
    finding = F.when(F.col("old_key") == "", "primary_key_added").when(
        F.col("new_key") == "", "primary_key_removed"
    ).otherwise("primary_key_changed")
    severity = F.when(F.col("old_key") == "", "warning").otherwise("breaking")
    return both.filter("old_key <> new_key").select(
        "table_name", "old_key", "new_key", finding.alias("finding"), severity.alias("severity")
    )


class NotConformable(ValueError):
    """The data would lose values in the target schema."""


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Target order and types: missing nullable columns become NULL, safe widenings are cast."""
    out = []
    for f in target.fields:
        if f.name not in df.columns:
            if not f.nullable:
                raise NotConformable(f"required column {f.name!r} is missing")
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        found = df.schema[f.name].dataType
        if found != f.dataType and not _widens(found, f.dataType):
            raise NotConformable(f"{f.name}: {found.simpleString()} to {f.dataType.simpleString()}")
        out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return df.select(*out)


_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _widens(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(new, T.StringType):
        return isinstance(old, T.StringType)
    if isinstance(old, _NUMBERS) and isinstance(new, _NUMBERS):
        return _NUMBERS.index(type(old)) <= _NUMBERS.index(type(new))
    if isinstance(old, _NUMBERS[:3]) and isinstance(new, T.DoubleType):
        return True
    if isinstance(old, _NUMBERS) and isinstance(new, T.DecimalType):
        digits = (3, 5, 10, 19)[_NUMBERS.index(type(old))]
        return new.precision - new.scale >= digits
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    if isinstance(old, T.FloatType) and isinstance(new, T.DoubleType):
        return True
    return isinstance(old, T.DateType) and isinstance(new, (T.TimestampType, T.TimestampNTZType))
