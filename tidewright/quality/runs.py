"""Quality runs: the checks of a table with the defaults, and their results as typed history rows."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.quality.scoring import Thresholds, gate, score
from tidewright.quality.suite import Context, _described, bare_type, run_suite
from tidewright.specs import Check

SKIP_DEFAULTS = "skip_defaults"
SKIP_SEVERITY = "skip"
# The check that every table gets.
DEFAULT_CHECK = Check(
    "row_count_change_within_percent",
    params={"direction": "both", "max_change_percent": 20.0},
    severity="warning",
    tags=("run_comparison", "default"),
    description="Alert if row count changes by more than 20% compared to previous run",
)


def with_defaults(checks: Sequence[Check]) -> list[Check]:
    """The checks behind the default one, unless one of its type is configured or one carries ``skip_defaults``."""
    configured = {bare_type(c) for c in checks}
    if DEFAULT_CHECK.type in configured or any(SKIP_DEFAULTS in c.tags for c in checks):
        return list(checks)
    return [DEFAULT_CHECK, *checks]


def run_checks(df: DataFrame, checks: Sequence[Check], context: Context | None = None) -> DataFrame:
    """One result row per configured or default check; those of severity ``skip`` are reported as skipped and not run.

    Without an earlier run the default check has nothing to compare with and is skipped too.
    """
    context = context or Context()
    chosen = with_defaults(checks)
    idle = {}
    for i, c in enumerate(chosen):
        if c.severity == SKIP_SEVERITY:
            idle[i] = "severity skip"
        elif c is DEFAULT_CHECK and context.baseline is None:
            idle[i] = "no earlier run"
    active = [c for i, c in enumerate(chosen) if i not in idle]
    results = run_suite(df, active, context)
    if not idle:
        return results
    rows = [replace(chosen[i], position=k) for k, i in enumerate(idle)]
    verdicts = {k: ("skipped", idle[i]) for k, i in enumerate(idle)}
    return results.unionByName(_described(df.sparkSession, rows, verdicts, None))


# The columns of the history of quality results.
_TEXT, _LONG, _FLAG = T.StringType(), T.LongType(), T.BooleanType()
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("run_id", _TEXT, False),
        T.StructField("run_timestamp", T.TimestampType(), False),
        T.StructField("run_date", _TEXT, False),
        T.StructField("pipeline_name", _TEXT, False),
        T.StructField("table_name", _TEXT, False),
        T.StructField("check_type", _TEXT, False),
        T.StructField("check_id", _TEXT, False),
        T.StructField("expectation_type", _TEXT, False),
        T.StructField("column_name", _TEXT),
        T.StructField("success", _FLAG, False),
        T.StructField("severity", _TEXT, False),
        T.StructField("blocking", _FLAG, False),
        T.StructField("description", _TEXT),
        T.StructField("unexpected_count", _LONG),
        T.StructField("unexpected_percent", T.DoubleType()),
        T.StructField("observed_value", _TEXT),
        T.StructField("tags", _TEXT),
        T.StructField("details", _TEXT),
        T.StructField("total_checks", T.IntegerType()),
        T.StructField("passed_checks", T.IntegerType()),
        T.StructField("failed_checks", T.IntegerType()),
        T.StructField("success_rate", T.DoubleType()),
        T.StructField("should_block", _FLAG),
        T.StructField("threshold_breached", _FLAG),
        T.StructField("since_timestamp", T.TimestampType()),
        T.StructField("incremental_mode", _FLAG),
        T.StructField("total_source_records", _LONG),
        T.StructField("validated_records", _LONG),
    ]
)


class HistoryMismatch(ValueError):
    """Rows that do not fit the history's columns."""


@dataclass(frozen=True)
class Run:
    """What identifies a run, and which part of the table it looked at."""

    run_id: str
    run_timestamp: str
    pipeline: str
    table: str
    since: str | None = None
    total_source_records: int | None = None
    validated_records: int | None = None


def history_rows(results: DataFrame, run: Run, checks: Sequence[Check] = (), thresholds: Thresholds | None = None) -> DataFrame:
    """Judged results of a run as rows of the history, each with the run's totals and gate; skipped checks have no row."""
    spark = results.sparkSession
    facts = {c.check_id: (c.check_id, c.description, json.dumps(list(c.tags))) for c in with_defaults(checks)}
    noted = spark.createDataFrame(list(facts.values()), "check_id string, description string, tags string")
    totals = gate(score(results), thresholds).select(
        "total_checks", "passed_checks", "failed_checks", "success_rate", "should_block", "threshold_breached"
    )
    when = F.lit(run.run_timestamp).cast("timestamp")
    tagged = {
        "run_id": F.lit(run.run_id),
        "run_timestamp": when,
        "run_date": F.date_format(when, "yyyy-MM-dd"),
        "pipeline_name": F.lit(run.pipeline),
        "table_name": F.lit(run.table),
        "expectation_type": F.concat(F.lit("expect_"), F.col("check_type")),
        "check_type": F.lit("quality_check"),
        "details": F.to_json(F.struct("element_count", "stage", "status", "detail")),
        "since_timestamp": F.lit(run.since).cast("timestamp"),
        "incremental_mode": F.lit(run.since is not None),
        "total_source_records": F.lit(run.total_source_records).cast("long"),
        "validated_records": F.lit(run.validated_records).cast("long"),
    }
    judged = results.filter(F.col("status").isin("passed", "failed"))
    # one row per check on the left, one per check and a single one on the right
    rows = judged.join(noted, "check_id", "left").crossJoin(F.broadcast(totals))
    return fit_history(rows.select("*", *[c.alias(f"_tw_{n}") for n, c in tagged.items()]).select(
        *[(F.col(f"_tw_{f.name}") if f.name in tagged else F.col(f.name)).alias(f.name) for f in HISTORY_SCHEMA.fields]))


def fit_history(rows: DataFrame) -> DataFrame:
    """Rows in the history's columns and types; a column that is missing, unknown or of another kind is an error."""
    wanted = {f.name: f for f in HISTORY_SCHEMA.fields}
    missing = [n for n, f in wanted.items() if n not in rows.columns and not f.nullable]
    unknown = [c for c in rows.columns if c not in wanted]
    if missing or unknown:
        raise HistoryMismatch(f"missing: {missing}, unknown: {unknown}")

    def fitted(f: T.StructField) -> Column:
        if f.name not in rows.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        kind = rows.schema[f.name].dataType
        if kind != f.dataType and not isinstance(kind, T.NullType):
            numbers = isinstance(kind, T.NumericType) and isinstance(f.dataType, T.NumericType)
            times = isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and isinstance(f.dataType, T.TimestampType)
            if not (numbers or times):
                raise HistoryMismatch(f"{f.name} is {kind.simpleString()}, not {f.dataType.simpleString()}")
        value = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"{f.name} is NULL")).cast(f.dataType))
        return value.alias(f.name)

    return rows.select(*[fitted(f) for f in HISTORY_SCHEMA.fields])


def append_history(rows: DataFrame, path: str) -> None:
    """Append rows of the history, partitioned by their date."""
    fit_history(rows).write.mode("append").partitionBy("run_date").parquet(path)


def read_history(
    spark: SparkSession, path: str, table: str | None = None, pipeline: str | None = None, from_date: str | None = None
) -> DataFrame:
    """The history, newest run first; the schema is stated, so reading infers nothing, and the date prunes folders."""
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(path).select(*HISTORY_SCHEMA.names)
    for column, value in (("table_name", table), ("pipeline_name", pipeline)):
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    if from_date is not None:
        rows = rows.filter(F.col("run_date") >= from_date)
    return rows.orderBy(F.col("run_timestamp").desc(), "check_id")
