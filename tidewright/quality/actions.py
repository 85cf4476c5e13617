"""What happens to rows that break a rule: fail the run, set the row aside, or only count it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.quality.suite import bare_type, row_rules
from tidewright.specs import Check, TableDef

FAIL, DROP, WARN = "FAIL", "DROP", "WARN"


def action_of(check: Check) -> str:
    """Only a blocking check fails the run; otherwise the severity decides."""
    if check.blocking:
        return FAIL
    return DROP if check.severity in ("critical", "error", "warning") else WARN


def row_constraints(spec: TableDef) -> list[Check]:
    """Row-local rules of a table: keys and required columns not null, plus its accepted values."""
    required = [
        Check("column_values_to_not_be_null", c.name, severity="critical", blocking=True,
              id=f"not_null_{c.name}")
        for c in spec.columns
        if c.required or c.name in spec.primary_key
    ]
    sets = [c for c in spec.checks if bare_type(c) in ("column_values_to_be_in_set", "accepted_values")]
    return [*required, *sets]


@dataclass(frozen=True)
class Split:
    clean: DataFrame
    quarantined: DataFrame
    fatal: DataFrame


def tag_violations(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Add ``_violations`` (names of broken rules) and ``_action`` (the gravest consequence)."""
    rules = row_rules(df, checks)
    named = F.array_compact(F.array(*[F.when(bad, F.lit(c.check_id)) for c, bad, _ in rules]))

    def any_of(action: str):
        out = F.lit(False)
        for c, bad, _ in rules:
            if action_of(c) == action:
                out = out | bad
        return out

    action = (
        F.when(any_of(FAIL), FAIL).when(any_of(DROP), DROP).when(any_of(WARN), WARN)
    )
    return df.select("*", named.alias("_violations"), action.alias("_action"))


def split_rows(df: DataFrame, checks: Sequence[Check]) -> Split:
    """Clean rows (warnings included), rows set aside, and rows that must fail the run."""
    tagged = tag_violations(df, checks)
    action = F.col("_action")
    return Split(
        tagged.filter(action.isNull() | (action == WARN)).select(*df.columns),
        tagged.filter(action == DROP).drop("_action"),
        tagged.filter(action == FAIL).drop("_action"),
    )
