"""A whole suite of checks as one DataFrame of results, one row per check.

Row-level and column-statistic checks share one aggregation over the table, those by sketches a second
one, and checks that need groups one grouping of all their columns' values; only checks of distributions, other
tables and orders have plans of their own. So a suite is a single Spark action, of three scans, however many checks it holds. A check that cannot be evaluated is reported as
failed, a pending one as pending; none is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.aggregates import facts_in_one_pass
from tidewright.operators.ranking import top_n
from tidewright.quality import drift
from tidewright.quality.predicates import ROW_RULES, RowRule, Unsupported, column_of, param
from tidewright.specs import Check

PENDING = "validation_rule_pending_implementation"
SAMPLE_SIZE = 10

RESULT_SCHEMA = T.StructType(
    [
        T.StructField("check_id", T.StringType()),
        T.StructField("check_type", T.StringType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("stage", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("blocking", T.BooleanType()),
        T.StructField("status", T.StringType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("element_count", T.LongType()),
        T.StructField("unexpected_count", T.LongType()),
        T.StructField("unexpected_percent", T.DoubleType()),
        T.StructField("observed_value", T.StringType()),
        T.StructField("detail", T.StringType()),
    ]
)


@dataclass(frozen=True)
class Context:
    """What checks may refer to beside the table: earlier data and other tables."""

    baseline: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)


def bare_type(check: Check) -> str:
    return check.type.removeprefix("expect_")


def _result(
    check: Check,
    success: Column,
    element: Column | None = None,
    unexpected: Column | None = None,
    observed: Column | None = None,
) -> Column:
    """What the data says about a check; its description is joined to it at the end."""
    null = F.lit(None)
    return F.struct(
        F.lit(check.position).alias("position"),
        success.cast("boolean").alias("success"),
        (element if element is not None else null).cast("bigint").alias("element_count"),
        (unexpected if unexpected is not None else null).cast("bigint").alias("unexpected_count"),
        (observed if observed is not None else null).cast("string").alias("observed_value"),
    )


DESCRIPTION = (
    "position int, check_id string, check_type string, column_name string, stage string, "
    "severity string, blocking boolean, verdict string, detail string"
)


def _described(
    spark: SparkSession,
    checks: Sequence[Check],
    verdicts: dict[int, tuple[str, str]],
    found: DataFrame | None,
) -> DataFrame:
    """One row per check: its description with its result, or with its verdict if it has none.

    Both sides hold one row per check of the suite.
    """
    rows = [
        (c.position, c.check_id, bare_type(c), c.column, c.stage, c.severity, c.blocking,
         *verdicts.get(c.position, (None, None)))
        for c in checks
    ]
    described = spark.createDataFrame(rows, DESCRIPTION)
    if found is None:
        blank = [F.lit(None).cast(t) for t in ("boolean", "bigint", "bigint", "string")]
        names = ("success", "element_count", "unexpected_count", "observed_value")
        joined = described.select("*", *[b.alias(n) for b, n in zip(blank, names)])
    else:
        joined = described.join(found, "position", "left")
    element, unexpected = F.col("element_count"), F.col("unexpected_count")
    percent = F.when(element > 0, F.round(unexpected * 100.0 / element, 6)).when(
        element == 0, F.lit(0.0)
    )
    judged = F.when(F.col("success"), "passed").otherwise("failed")
    values = {
        "status": F.coalesce("verdict", judged),
        "success": F.when(F.col("verdict") == "failed", False).otherwise(F.col("success")),
        "unexpected_percent": percent,
    }
    return joined.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RESULT_SCHEMA.fields]
    )


def _counted(check: Check, element: Column, unexpected: Column, observed: Column | None = None):
    enough = F.lit(1.0) - unexpected / F.nullif(element, F.lit(0)) >= F.lit(float(check.mostly))
    return _result(check, F.coalesce(enough, F.lit(True)), element, unexpected, observed)


def _scope(check: Check) -> Column:
    return F.expr(check.where) if check.where else F.lit(True)


def _row_check(check: Check, rule: RowRule) -> Column:
    scope = F.coalesce(_scope(check) & rule.scope, F.lit(False))
    bad = scope & F.coalesce(rule.bad, F.lit(False))
    return _counted(check, F.count_if(scope), F.count_if(bad))


def _within(value: Column, check: Check) -> Column:
    ok = F.lit(True)
    if check.params.get("min_value") is not None:
        ok = ok & (value >= F.lit(check.params["min_value"]))
    if check.params.get("max_value") is not None:
        ok = ok & (value <= F.lit(check.params["max_value"]))
    return F.coalesce(ok, F.lit(False))


def _shown(value: Column, digits: int = 4) -> Column:
    return F.round(value.cast("double"), digits).cast("string")


# --- checks on one statistic of a column, part of the shared aggregation --------------------

STATISTICS: dict[str, Callable[[Column, Check], Column]] = {
    "column_min_to_be_between": lambda c, k: F.min(c),
    "column_max_to_be_between": lambda c, k: F.max(c),
    "column_mean_to_be_between": lambda c, k: F.avg(c),
    "column_sum_to_be_between": lambda c, k: F.sum(c),
    "column_stdev_to_be_between": lambda c, k: F.stddev_samp(c),
    "column_median_to_be_between": lambda c, k: (
        F.percentile(c, 0.5) if k.params.get("exact") else F.percentile_approx(c, 0.5, 10000)
    ),
    "column_skewness_to_be_between": lambda c, k: F.skewness(c),
    "column_proportion_of_non_null_values_to_be_between": lambda c, k: F.count(c) / F.count(F.lit(1)),
}


def _statistic(check: Check, schema: T.StructType) -> Column:
    c = column_of(check, schema)
    if check.where:
        c = F.when(F.expr(check.where), c)
    value = STATISTICS[bare_type(check)](c, check)
    return _result(check, _within(value, check), observed=_shown(value))


def _quantiles(check: Check, schema: T.StructType) -> Column:
    ranges = param(check, "quantile_ranges")
    c = column_of(check, schema)
    probabilities = [float(q) for q in ranges["quantiles"]]
    if check.params.get("exact"):
        found = F.percentile(c, probabilities)
    else:
        found = F.percentile_approx(c, probabilities, 10000)
    ok = F.lit(True)
    for i, (low, high) in enumerate(ranges["value_ranges"]):
        v = F.get(found, i)
        ok = ok & (F.lit(True) if low is None else v >= low)
        ok = ok & (F.lit(True) if high is None else v <= high)
    return _result(check, F.coalesce(ok, F.lit(False)), observed=F.to_json(found))


def _contains_set(check: Check, schema: T.StructType) -> Column:
    c = column_of(check, schema)
    wanted = list(param(check, "value_set"))
    seen = [F.count_if(c == F.lit(v)) > 0 for v in wanted]
    missing = reduce(lambda a, b: a + b, [(~s).cast("int") for s in seen])
    return _result(check, missing == 0, F.lit(len(wanted)), missing)


def _row_count(check: Check, schema: T.StructType) -> Column:
    n = F.count(F.lit(1))
    return _result(check, _within(n, check), observed=n.cast("string"))


def _row_count_equal(check: Check, schema: T.StructType) -> Column:
    n = F.count(F.lit(1))
    return _result(check, n == F.lit(param(check, "value")), observed=n.cast("string"))


SCALAR: dict[str, Callable[[Check, T.StructType], Column]] = {
    **{name: _statistic for name in STATISTICS},
    "column_quantile_values_to_be_between": _quantiles,
    "column_distinct_values_to_contain_set": _contains_set,
    "table_row_count_to_be_between": _row_count,
    "table_row_count_to_equal": _row_count_equal,
}


SKETCHES = {
    "column_median_to_be_between",
    "column_quantile_values_to_be_between",
    "column_skewness_to_be_between",
    "column_stdev_to_be_between",
}


# --- checks on the schema alone: literals beside the aggregation -----------------------------


def _schema_result(check: Check, ok: bool, observed: str | None = None) -> Column:
    return _result(check, F.lit(ok), observed=F.lit(observed))


def _type_names(dtype: T.DataType) -> set[str]:
    return {type(dtype).__name__.lower(), dtype.simpleString().lower()}


def _schema_check(check: Check, schema: T.StructType) -> Column | None:
    kind, names = bare_type(check), schema.fieldNames()
    if kind == "table_column_count_to_equal":
        return _schema_result(check, len(names) == param(check, "value"), str(len(names)))
    if kind == "table_column_count_to_be_between":
        low, high = check.params.get("min_value"), check.params.get("max_value")
        ok = (low is None or len(names) >= low) and (high is None or len(names) <= high)
        return _schema_result(check, ok, str(len(names)))
    if kind == "table_columns_to_match_ordered_list":
        wanted = list(param(check, "column_list"))
        size = max(len(wanted), len(names))
        pairs = zip(wanted + [None] * (size - len(wanted)), names + [None] * (size - len(names)))
        wrong = [f"{i}:{w}/{n}" for i, (w, n) in enumerate(pairs) if w != n]
        return _schema_result(check, not wrong, ",".join(wrong))
    if kind == "table_columns_to_match_set":
        wanted = set(param(check, "column_set"))
        exact = check.params.get("exact_match", True)
        ok = wanted == set(names) if exact else wanted <= set(names)
        return _schema_result(check, ok, ",".join(sorted(wanted ^ set(names))))
    if kind == "column_to_exist":
        return _schema_result(check, check.column in names)
    if kind in ("column_values_to_be_of_type", "column_values_to_be_in_type_list"):
        column_of(check, schema)
        wanted = check.params.get("type_list") or [param(check, "type_")]
        dtype = schema[check.column].dataType
        ok = bool({w.lower() for w in wanted} & _type_names(dtype))
        return _schema_result(check, ok, dtype.simpleString())
    if kind == "embedding_dimension_multiple_of_16_advisory":
        n = param(check, "dimension")
        return _schema_result(check, True, f"{n}%16={n % 16}")
    return None


# --- checks on groups: one grouping for all tuples of columns ---------------------------------

TEXT_GROUPS = {"column_most_common_value_to_be_in_set", "column_kl_divergence_to_be_less_than"}
GROUPED = {
    "column_values_to_be_unique",
    "compound_columns_to_be_unique",
    "column_unique_value_count_to_be_between",
    "column_proportion_of_unique_values_to_be_between",
    "column_most_common_value_to_be_in_set",
    "column_kl_divergence_to_be_less_than",
}


def _group_columns(check: Check, schema: T.StructType) -> tuple[str, ...]:
    if bare_type(check) == "compound_columns_to_be_unique":
        columns = tuple(param(check, "column_list"))
        if len(columns) < 2:
            raise Unsupported("a compound check needs two columns or more")
    else:
        columns = (check.column or "",)
    for name in columns:
        column_of(check, schema, name)
    return columns


def _group_cells(slots: dict[tuple, int]) -> Column:
    """Structs of a row, one for each (columns, filter, with text) whose filter admits it: the values by their hashes."""
    cells = []
    for (columns, where, texts), slot in slots.items():
        held = [F.col(f"`{c}`") for c in columns]
        missing = [h.isNull() for h in held]
        cell = F.struct(
            F.lit(slot).alias("slot"), F.xxhash64(*held).alias("a"), F.xxhash64(F.lit("b"), *held).alias("b"),
            reduce(lambda x, y: x | y, missing).alias("some_missing"), reduce(lambda x, y: x & y, missing).alias("all_missing"),
            # NULLs leave no trace in a hash of several columns
            F.concat(*[m.cast("int").cast("string") for m in missing]).alias("which"),
            (held[0].cast("string") if texts else F.lit(None).cast("string")).alias("text"),
        )
        cells.append(F.when(F.expr(where), cell) if where else cell)
    return F.array_compact(F.array(*cells))


def _group_check(check: Check, slot: int) -> Column:
    """Aggregate over one row per group of any slot: its size ``_n``, its value's text, what is missing in it."""
    kind, n, text = bare_type(check), F.col("_n"), F.col("text")
    scope = F.col("slot") == slot
    if kind == "compound_columns_to_be_unique":
        ignore = check.params.get("ignore_row_if", "never")
        if ignore == "any_value_is_missing":
            scope = scope & ~F.col("some_missing")
        elif ignore == "all_values_are_missing":
            scope = scope & ~F.col("all_missing")
        elif ignore != "never":
            raise Unsupported(f"ignore_row_if {ignore!r}")
    else:
        scope = scope & ~F.col("some_missing")
    rows = F.coalesce(F.sum(F.when(scope, n)), F.lit(0))
    if kind in ("column_values_to_be_unique", "compound_columns_to_be_unique"):
        repeated = F.coalesce(F.sum(F.when(scope & (n > 1), n)), F.lit(0))
        return _counted(check, rows, repeated)
    distinct = F.count_if(scope)
    if kind == "column_unique_value_count_to_be_between":
        return _result(check, _within(distinct, check), observed=distinct.cast("string"))
    if kind == "column_proportion_of_unique_values_to_be_between":
        share = distinct / F.nullif(rows, F.lit(0))
        return _result(check, _within(share, check), observed=_shown(share))
    if kind == "column_most_common_value_to_be_in_set":
        # the smallest value among equally common ones
        least = F.min_by(text, F.when(scope, F.struct(-n, text)))
        wanted = [str(v) for v in param(check, "value_set")]
        return _result(check, F.coalesce(least.isin(*wanted), F.lit(False)), observed=least)
    expected = param(check, "partition")
    pairs = [F.lit(x) for kv in expected.items() for x in (str(kv[0]), float(kv[1]))]
    weight = F.try_element_at(F.create_map(*pairs), text)
    # sum p ln(p/w) over observed values = (sum n ln(n/w)) / N - ln N
    outside = F.count_if(scope & weight.isNull())
    terms = F.sum(F.when(scope, n * F.ln(n / weight)))
    divergence = F.when(outside == 0, terms / rows - F.ln(rows))
    ok = F.coalesce(divergence <= F.lit(param(check, "threshold")), F.lit(False))
    return _result(check, ok, rows, outside, _shown(divergence, 6))


# --- checks that need their own plan ---------------------------------------------------------


def _one_row(df: DataFrame, result: Column) -> DataFrame:
    return df.agg(result.alias("r")).select("r.*")


def _count_against(df: DataFrame, other: DataFrame) -> DataFrame:
    """One row with both row counts, without joining the tables."""
    mine = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit("c").alias("s"), "n")
    theirs = other.agg(F.count(F.lit(1)).alias("n")).select(F.lit("b").alias("s"), "n")
    return mine.unionAll(theirs)


def _side(which: str) -> Column:
    return F.max(F.when(F.col("s") == which, F.col("n")))


def _equal_other_table(df: DataFrame, check: Check, context: Context) -> DataFrame:
    name = param(check, "other_table_name")
    if name not in context.tables:
        raise Unsupported(f"table {name!r} was not given")
    both = _count_against(df, context.tables[name])
    return _one_row(
        both,
        _result(check, _side("c") == _side("b"), observed=F.concat_ws("/", _side("c"), _side("b"))),
    )


def _row_count_change(df: DataFrame, check: Check, context: Context) -> DataFrame:
    if context.baseline is None:
        raise Unsupported("no baseline was given")
    limit = float(check.params.get("max_change_percent", 20.0))
    direction = check.params.get("direction", "both")
    current, previous = _side("c"), _side("b")
    change = drift.percent_change(current, previous)
    within = {
        "both": F.abs(change) <= limit,
        "increase": change <= limit,
        "decrease": change >= -limit,
    }[direction]
    return _one_row(
        _count_against(df, context.baseline), _result(check, within, observed=_shown(change))
    )


def _distribution_stable(df: DataFrame, check: Check, context: Context) -> DataFrame:
    if context.baseline is None:
        raise Unsupported("no baseline was given")
    column_of(check, df.schema)
    limit = float(check.params.get("max_divergence", 0.1))
    report = drift.distribution_drift(context.baseline, df, [check.column])
    d = F.max("js_divergence")
    return _one_row(report, _result(check, d <= limit, observed=_shown(d, 6)))


def _records_stable(df: DataFrame, check: Check, context: Context) -> DataFrame:
    if context.baseline is None:
        raise Unsupported("no baseline was given")
    summary = drift.record_summary(context.baseline, df, list(param(check, "key_columns")))
    ok = F.lit(True)
    for part in ("added", "removed", "modified"):
        limit = check.params.get(f"max_{part}_percent")
        if limit is not None:
            ok = ok & (F.max(f"{part}_percent") <= float(limit))
    shown = F.concat_ws(
        "/", *[_shown(F.max(f"{p}_percent")) for p in ("added", "removed", "modified")]
    )
    return _one_row(summary, _result(check, ok, observed=shown))


def _complete_periods(df: DataFrame, check: Check, context: Context) -> DataFrame:
    """Every day, month or year between the first and last date holds a row."""
    c = column_of(check, df.schema)
    period = check.params.get("period", "day")
    if period not in ("day", "week", "month", "quarter", "year"):
        raise Unsupported(f"period {period!r}")
    start = F.date_trunc(period, c.cast("timestamp")).cast("date")
    present = df.filter(c.isNotNull()).select(start.alias("p")).distinct()
    step = {"quarter": "interval 3 month"}.get(period, f"interval 1 {period}")
    calendar = present.agg(F.min("p").alias("lo"), F.max("p").alias("hi")).select(
        F.explode(F.sequence("lo", "hi", F.expr(step))).alias("p")
    )
    seen = calendar.join(present.withColumn("hit", F.lit(True)), "p", "left")
    return _one_row(seen, _counted(check, F.count("p"), F.count_if(F.col("hit").isNull())))


def _monotonic(df: DataFrame, check: Check, context: Context) -> DataFrame:
    """Each value against its predecessor in the declared order.

    The rows are range-partitioned by the order columns, compared inside each partition, and the
    partition edges (one row each) are compared among themselves.
    """
    c = column_of(check, df.schema)
    order = list(check.params.get("order_by") or [])
    if not order:
        raise Unsupported("order_by is needed: a table has no order of its own")
    for name in order:
        column_of(check, df.schema, name)
    increasing = bare_type(check).endswith("increasing")
    strictly = check.params.get("strictly", False)
    order_key = F.struct(*[F.col(o) for o in order])
    rows = (
        df.filter(c.isNotNull())
        .select(order_key.alias("o"), c.alias("v"))
        .repartitionByRange("o")
        .withColumn("pid", F.spark_partition_id())
    )

    def broken(value: Column, before: Column) -> Column:
        if increasing:
            return (value <= before) if strictly else (value < before)
        return (value >= before) if strictly else (value > before)

    # ties of the declared order stand in the direction that is checked, so reruns agree
    tie = F.col("v").asc() if increasing else F.col("v").desc()
    inside = Window.partitionBy("pid").orderBy("o", tie)
    stepped = rows.withColumn("bad", broken(F.col("v"), F.lag("v").over(inside)))
    stepped = stepped.withColumn("place", F.row_number().over(inside))
    edges = stepped.groupBy("pid").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("bad").alias("bad"),
        F.min("o").alias("first"),
        F.min_by("v", "place").alias("head"),
        F.max_by("v", "place").alias("tail"),
    )
    # as many rows as range partitions, whatever the size of the table
    across = Window.orderBy("first")
    joined = edges.withColumn(
        "edge", broken(F.col("head"), F.lag("tail").over(across)).cast("int")
    )
    bad = F.coalesce(F.sum("bad"), F.lit(0)) + F.coalesce(F.sum("edge"), F.lit(0))
    return _one_row(joined, _counted(check, F.coalesce(F.sum("n"), F.lit(0)), bad))


def _relationship(df: DataFrame, check: Check, context: Context) -> DataFrame:
    from tidewright.operators.joins import fk_coverage

    name = param(check, "parent")
    if name not in context.tables:
        raise Unsupported(f"table {name!r} was not given")
    column_of(check, df.schema)
    counts = fk_coverage(df, context.tables[name], {check.column: param(check, "parent_column")})
    return _one_row(counts, _counted(check, F.max("keyed_rows"), F.max("orphan_rows")))


OWN_PLAN: dict[str, Callable[[DataFrame, Check, Context], DataFrame]] = {
    "table_row_count_to_equal_other_table": _equal_other_table,
    "row_count_change_within_percent": _row_count_change,
    "column_distribution_stable": _distribution_stable,
    "record_changes_within_limits": _records_stable,
    "date_column_to_have_complete_periods": _complete_periods,
    "column_values_to_be_increasing": _monotonic,
    "column_values_to_be_decreasing": _monotonic,
    "relationship": _relationship,
}


# --- running a suite -------------------------------------------------------------------------


def _in_one_pass(df: DataFrame, results: Sequence[Column]) -> list[DataFrame]:
    return [facts_in_one_pass(df, results)] if results else []


def _why_unresolved(df: DataFrame, results: Sequence[Column]) -> str | None:
    """Spark's complaint about the expressions, found by analysis alone."""
    try:
        df.agg(*results)
    except AnalysisException as problem:
        return str(problem).splitlines()[0]
    return None


def run_suite(df: DataFrame, checks: Sequence[Check], context: Context | None = None) -> DataFrame:
    """One result row per check (see the module's description)."""
    context = context or Context()
    schema = df.schema
    checks = [replace(c, position=i) for i, c in enumerate(checks)]
    verdicts: dict[int, tuple[str, str]] = {}
    evaluated: list[tuple[Check, Column]] = []
    literals: list[Column] = []
    slots: dict[tuple, int] = {}
    grouped: list[Column] = []
    parts: list[DataFrame] = []
    for check in checks:
        kind = bare_type(check)
        try:
            if kind == PENDING:
                verdicts[check.position] = ("pending", "not implemented yet")
            elif kind in ROW_RULES:
                evaluated.append((check, _row_check(check, ROW_RULES[kind](check, schema))))
            elif kind in SCALAR:
                evaluated.append((check, SCALAR[kind](check, schema)))
            elif kind in GROUPED:
                columns = _group_columns(check, schema)
                if check.where:
                    df.filter(F.expr(check.where))
                place = (columns, check.where, kind in TEXT_GROUPS)
                result = _group_check(check, slots.get(place, len(slots)))
                slots.setdefault(place, len(slots))
                grouped.append(result)
            elif kind in OWN_PLAN:
                rows = df.filter(F.expr(check.where)) if check.where else df
                parts.append(OWN_PLAN[kind](rows, check, context))
            else:
                literal = _schema_check(check, schema)
                if literal is None:
                    raise Unsupported(f"unsupported check type {check.type!r}")
                literals.append(literal)
        except (Unsupported, AnalysisException, KeyError) as problem:
            verdicts[check.position] = ("failed", str(problem).splitlines()[0])
    if evaluated and _why_unresolved(df, [r for _, r in evaluated]) is not None:
        # some expression does not resolve: it fails its own check and no other
        why = {c.position: _why_unresolved(df, [r]) for c, r in evaluated}
        verdicts |= {p: ("failed", w) for p, w in why.items() if w is not None}
        evaluated = [(c, r) for c, r in evaluated if why[c.position] is None]
    # sketches keep plain aggregates from compiled code, so they get their own pass
    sketched = [r for c, r in evaluated if bare_type(c) in SKETCHES]
    plain = [r for c, r in evaluated if bare_type(c) not in SKETCHES]
    parts += _in_one_pass(df, [*literals, *plain]) + _in_one_pass(df, sketched)
    if grouped:
        keys = ["slot", "a", "b", "some_missing", "all_missing", "which", "text"]
        groups = df.select(F.inline(_group_cells(slots))).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        parts += _in_one_pass(groups, grouped)
    found = reduce(lambda a, b: a.unionAll(b), parts) if parts else None
    return _described(df.sparkSession, checks, verdicts, found)


# Check types that read raw text, and those that need typed data.
RAW_TYPES = frozenset(
    (
        "table_columns_to_match_set",
        "table_row_count_to_be_between",
        "column_value_lengths_to_be_between",
        "column_value_lengths_to_equal",
        "column_values_to_match_regex",
        "column_values_to_not_match_regex",
        "column_values_to_match_regex_list",
        "column_values_to_cast_to_type",
        "column_values_to_not_be_null",
        "column_values_to_be_null",
        "column_values_to_match_strftime_format",
        "column_values_to_be_in_set",
        "column_values_to_not_be_in_set",
        "column_distinct_values_to_be_in_set",
        "column_distinct_values_to_contain_set",
        "column_most_common_value_to_be_in_set",
        "column_values_to_be_unique",
        "compound_columns_to_be_unique",
        "select_column_values_to_be_unique_within_record",
    )
)
REDUNDANT_TYPES = frozenset(("column_to_exist", "column_values_to_be_of_type"))
TYPED_TYPES = frozenset(
    (
        "column_values_to_be_between",
        "embedding_dimension_multiple_of_16_advisory",
        "column_pair_values_a_to_be_greater_than_b",
        "column_pair_values_to_be_equal",
        "validation_rule_pending_implementation",
        "date_column_to_have_complete_periods",
        "row_count_change_within_percent",
        "column_distribution_stable",
        "record_changes_within_limits",
    )
)


def stage_of(check: Check) -> str:
    """``raw``, ``ingested``, ``redundant`` or ``unknown``; a stated stage wins."""
    if check.stage:
        return check.stage
    kind = bare_type(check)
    if kind in REDUNDANT_TYPES:
        return "redundant"
    if kind in RAW_TYPES:
        return "raw"
    return "ingested" if kind in TYPED_TYPES else "unknown"


def run_staged(
    raw: DataFrame, typed: DataFrame, checks: Sequence[Check], context: Context | None = None
) -> DataFrame:
    """Raw checks on the raw frame, typed checks on the typed frame, the rest skipped by name."""
    routed: dict[str, list[Check]] = {}
    for check in checks:
        stage = stage_of(check)
        routed.setdefault(stage, []).append(replace(check, stage=stage))
    parts = []
    if routed.get("raw"):
        parts.append(run_suite(raw, routed["raw"], context))
    if routed.get("ingested"):
        parts.append(run_suite(typed, routed["ingested"], context))
    skipped = [
        replace(c, position=i)
        for i, c in enumerate(routed.get("redundant", []) + routed.get("unknown", []))
    ]
    verdicts = {c.position: ("skipped", f"{c.stage} check type") for c in skipped}
    parts.append(_described(typed.sparkSession, skipped, verdicts, None))
    return reduce(lambda a, b: a.unionAll(b), parts)


def row_rules(df: DataFrame, checks: Sequence[Check]) -> list[tuple[Check, Column, Column]]:
    """(check, is-unexpected, value) of every row-level check that can be evaluated."""
    out = []
    for check in checks:
        if bare_type(check) not in ROW_RULES:
            continue
        rule = ROW_RULES[bare_type(check)](check, df.schema)
        scope = F.coalesce(_scope(check) & rule.scope, F.lit(False))
        out.append((check, scope & F.coalesce(rule.bad, F.lit(False)), rule.value))
    return out


def failure_samples(
    df: DataFrame, checks: Sequence[Check], n: int = SAMPLE_SIZE, ordered: bool = False
) -> DataFrame:
    """Up to ``n`` distinct unexpected values per check with their counts, all checks in one pass.

    Values are chosen by hash, or the smallest when ``ordered``.
    """
    hits = [
        F.when(bad, F.struct(F.lit(c.check_id).alias("check_id"), v.cast("string").alias("value")))
        for c, bad, v in row_rules(df, checks)
    ]
    found = (
        df.select(F.explode(F.array_compact(F.array(*hits))).alias("h"))
        .groupBy("h.check_id", "h.value")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )
    order = [F.col("value").asc_nulls_first()]
    if not ordered:
        order = [F.xxhash64("value").asc(), *order]
    return top_n(found, ["check_id"], order, n)


def value_of(results: DataFrame, check_id: str, column: str) -> Any:
    """One field of one result, for tests and notebooks."""
    row = results.filter(F.col("check_id") == check_id).select(column).first()
    return row[0] if row else None
