"""From check results to a score, a gate and a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    max_failures: int | None = None
    max_critical_failures: int | None = None
    max_critical_failure_percent: float | None = None
    max_warning_failure_percent: float | None = None
    min_success_rate: float | None = None


def judged(results: DataFrame) -> DataFrame:
    """Results that count: pending and skipped checks are neither passed nor failed."""
    return results.filter(F.col("status").isin("passed", "failed"))


def score(results: DataFrame) -> DataFrame:
    """One row of totals and rates in percent; the severity ``error`` counts as critical."""
    failed = ~F.col("success")
    severity = F.col("severity")
    totals = judged(results).agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("success").alias("passed_checks"),
        F.count_if(failed).alias("failed_checks"),
        F.count_if(failed & severity.isin("critical", "error")).alias("critical_failures"),
        F.count_if(failed & (severity == "critical")).alias("strictly_critical_failures"),
        F.count_if(failed & (severity == "warning")).alias("warning_failures"),
        F.count_if(failed & (severity == "info")).alias("info_failures"),
        F.count_if(failed & F.col("blocking")).alias("blocking_failures"),
        F.count_if(failed & F.col("blocking") & severity.isin("critical", "error")).alias(
            "gating_failures"
        ),
    )

    def rate(part: str) -> Column:
        share = F.round(F.col(part) * 100.0 / F.nullif(F.col("total_checks"), F.lit(0)), 6)
        return F.coalesce(share, F.lit(0.0))

    return totals.withColumns(
        {
            "success_rate": rate("passed_checks"),
            "critical_failure_rate": rate("critical_failures"),
            "warning_failure_rate": rate("warning_failures"),
        }
    )


def gate(scored: DataFrame, thresholds: Thresholds | None = None) -> DataFrame:
    """Add ``threshold_breached`` and ``should_block`` to the score row."""
    t = thresholds or Thresholds()
    breached = F.lit(False)
    limits = (
        ("failed_checks", t.max_failures),
        ("strictly_critical_failures", t.max_critical_failures),
        ("critical_failure_rate", t.max_critical_failure_percent),
        ("warning_failure_rate", t.max_warning_failure_percent),
    )
    for column, limit in limits:
        if limit is not None:
            breached = breached | (F.col(column) > limit)
    if t.min_success_rate is not None:
        breached = breached | (F.col("success_rate") < t.min_success_rate)
    return scored.withColumn("threshold_breached", breached).withColumn(
        "should_block", F.col("threshold_breached") | (F.col("gating_failures") > 0)
    )


def report(results: DataFrame) -> DataFrame:
    """One row: counts by status, a one-line summary, the failed checks and the blocking flag."""
    names = F.array_sort(F.collect_list(F.when(F.col("status") == "failed", F.col("check_id"))))
    counted = results.agg(
        *[
            F.count_if(F.col("status") == s).alias(s)
            for s in ("passed", "failed", "pending", "skipped")
        ],
        F.count(F.lit(1)).alias("total"),
        F.array_join(names, ",").alias("failures"),
        F.coalesce(
            F.bool_or(
                (F.col("status") == "failed")
                & F.col("blocking")
                & F.col("severity").isin("critical", "error")
            ),
            F.lit(False),
        ).alias("blocked"),
    )
    line = F.format_string(
        "%d/%d checks passed, %d failed, %d pending, %d skipped",
        "passed",
        "total",
        "failed",
        "pending",
        "skipped",
    )
    return counted.withColumn("summary", line)
