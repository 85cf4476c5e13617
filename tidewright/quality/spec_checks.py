"""Every check that a table's specification implies, and the findings of running them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.formats import REGISTRY, strftime_of
from tidewright.quality.suite import Context, failure_samples, run_suite
from tidewright.specs import TEXT_TYPES, Check, ColumnSpec, TableDef

# Name prefixes that mark the two ends of a period.
START_PREFIXES = ("start_", "begin_", "effective_", "from_")
END_PREFIXES = ("end_", "stop_", "expiry_", "to_", "termination_")


def date_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    """(start, end) columns whose names differ only in a start and an end prefix."""
    by_lower = {n.lower(): n for n in names}
    pairs = []
    for lower, name in by_lower.items():
        prefix = next((p for p in START_PREFIXES if lower.startswith(p)), None)
        if prefix is None:
            continue
        stem = lower[len(prefix) :]
        pairs += [(name, by_lower[e + stem]) for e in END_PREFIXES if e + stem in by_lower]
    return pairs


def pair_checks(spec: TableDef) -> list[Check]:
    temporal = [c.name for c in spec.columns if c.kind in ("DATE", "DATETIME", "TIMESTAMP")]
    return [
        Check(
            "column_pair_values_a_to_be_greater_than_b",
            params={"column_A": end, "column_B": start, "or_equal": True},
            id=f"period:{start}:{end}",
            stage="ingested",
        )
        for start, end in date_pairs(temporal)
    ]


def _null_checks(c: ColumnSpec, context_column: str | None) -> list[Check]:
    if not c.required:
        return []
    kind = "column_values_to_not_be_null"
    if context_column and c.required_contexts:
        return [
            Check(
                kind,
                c.name,
                where=f"{context_column} = '{context}'",
                severity="critical",
                id=f"{kind}:{c.name}:{context}",
            )
            for context in c.required_contexts
        ]
    return [Check(kind, c.name, severity="critical")]


def _column_checks(c: ColumnSpec, as_text: bool) -> list[Check]:
    out = []
    if c.kind in TEXT_TYPES and c.length is not None:
        out.append(Check("column_value_lengths_to_be_between", c.name, {"max_value": c.length}))
    if c.kind == "EMBEDDING" and c.dimension is not None:
        out.append(
            Check("column_value_lengths_to_equal", c.name, {"value": c.dimension}, "critical",
                  stage="ingested")
        )
        out.append(
            Check(
                "embedding_dimension_multiple_of_16_advisory",
                c.name,
                {"dimension": c.dimension},
                "info",
            )
        )
    if as_text and c.kind not in TEXT_TYPES and c.kind not in ("EMBEDDING", "BOOLEAN"):
        params = {"target_type": c.kind, "precision": c.precision, "scale": c.scale, "bits": c.bits}
        if c.format:
            params["format"] = c.format
        out.append(Check("column_values_to_cast_to_type", c.name, params, "critical"))
        if c.format in REGISTRY:
            out.append(
                Check(
                    "column_values_to_match_strftime_format",
                    c.name,
                    {"strftime_format": strftime_of(c.format)},
                )
            )
    if c.domain:
        out.append(Check("column_values_to_match_domain_type", c.name, {"domain_type": c.domain}))
    return out


def implied_checks(spec: TableDef, native: Sequence[str] = ()) -> list[Check]:
    """All checks a specification implies.

    ``native`` names columns that land with their own type; checks of text shape are withheld there.
    """
    names = [c.name for c in spec.columns]
    out = [
        Check("table_column_count_to_equal", params={"value": len(names)}, severity="critical"),
        Check(
            "table_columns_to_match_ordered_list",
            params={"column_list": names},
            severity="critical",
        ),
    ]
    for c in spec.columns:
        out += _null_checks(c, spec.context_column)
        out += _column_checks(c, as_text=c.name not in native)
    if len(spec.primary_key) > 1:
        out.append(
            Check(
                "compound_columns_to_be_unique",
                params={"column_list": list(spec.primary_key)},
                severity="critical",
            )
        )
    elif spec.primary_key:
        out.append(
            Check("column_values_to_be_unique", spec.primary_key[0], severity="critical")
        )
    return [*out, *pair_checks(spec), *spec.checks]


def native_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if not isinstance(f.dataType, T.StringType)]


def check_table(df: DataFrame, spec: TableDef, context: Context | None = None) -> DataFrame:
    return run_suite(df, implied_checks(spec, native_columns(df.schema)), context)


def _schema_findings(df: DataFrame, spec: TableDef) -> list[tuple]:
    names, rows = df.columns, []
    for c in spec.columns:
        if c.name not in names:
            rows.append(("missing_column", "error", c.name, "column declared", None))
            continue
        found = df.schema[c.name].dataType
        if not isinstance(found, T.StringType) and found != c.spark_type:
            shown = f"{c.spark_type.simpleString()} declared, {found.simpleString()} found"
            rows.append(("type_mismatch", "error", c.name, shown, None))
    declared = {c.name for c in spec.columns}
    rows += [
        ("unexpected_column", "warning", n, "column not declared", None)
        for n in names
        if n not in declared and not n.startswith("meta_")
    ]
    return rows


ERROR_SCHEMA = "error_type string, severity string, column_name string, rule string, row_count bigint"


def table_errors(df: DataFrame, spec: TableDef, context: Context | None = None) -> DataFrame:
    """One row per finding: schema differences, then every failed check with value samples."""
    schema_rows = df.sparkSession.createDataFrame(_schema_findings(df, spec), ERROR_SCHEMA)
    present = [
        k
        for k in implied_checks(spec, native_columns(df.schema))
        if (k.column is None or k.column in df.columns)
        and k.type not in ("table_column_count_to_equal", "table_columns_to_match_ordered_list")
    ]
    failed = run_suite(df, present, context).filter(F.col("status") == "failed")
    samples = (
        failure_samples(df, present, ordered=True)
        .groupBy("check_id")
        .agg(F.array_join(F.array_sort(F.collect_list("value")), ",").alias("samples"))
    )
    # one row per check on either side
    found = failed.join(samples, "check_id", "left").select(
        F.lit("check_failed").alias("error_type"),
        "severity",
        "column_name",
        F.col("check_id").alias("rule"),
        F.col("unexpected_count").alias("row_count"),
        "samples",
    )
    return schema_rows.withColumn("samples", F.lit(None).cast("string")).unionByName(found)
