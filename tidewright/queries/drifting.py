"""Drift between two states of a table."""

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.sets import value_difference
from tidewright.profiling.columns import frequent_values
from tidewright.quality import drift
from tidewright.quality.runs import Run, append_history, history_rows, read_history, run_checks
from tidewright.quality.suite import PENDING, Context, run_suite
from tidewright.queries import query
from tidewright.session import scratch_path
from tidewright.specs import Check

HALF = "timestamp '2024-01-16'"


def halves(t):
    """Events before and after the middle of the month; the later half has changed text."""
    split = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    old = t.events.filter(F.col("ts") < split)
    new = t.events.filter(F.col("ts") >= split).withColumn(
        "event_type",
        F.when(F.col("event_type") == "signup", "join")
        .when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), None)
        .otherwise(F.col("event_type")),
    )
    return old, new


HALVES_SQL = f"""o as (select * from events where ts < {HALF}),
  n as (select event_id, ts, user_id, value, props, case when event_type = 'signup' then 'join'
          when event_type = 'error' and event_id % 2 = 0 then null else event_type end as event_type
        from events where ts >= {HALF})"""


@query(
    "drift_rowcount",
    "QB-02",
    f"""with {HALVES_SQL}, c as (select (select count(*) from o) p, (select count(*) from n) q)
       select p as previous_count, q as current_count, q - p as absolute_change,
         round((q - p) * 100.0 / p, 6) as percent_change,
         case when q > p then 'increase' when q < p then 'decrease' else 'unchanged' end as direction
       from c""",
)
def drift_rowcount(t):
    return drift.row_count_drift(*halves(t))


def js_sql(columns: list[str]) -> str:
    """Divergence of the two halves for each column, from the formula."""
    parts = []
    for c in columns:
        parts.append(f"""
          select '{c}' as column_name, round(greatest(0, least(1,
                   sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / 2 / ln(2))), 6)
                   as js_divergence,
                 count(*) filter (where a > 0 and v <> '__NULL__') as previous_distinct,
                 count(*) filter (where b > 0 and v <> '__NULL__') as current_distinct,
                 count(*) filter (where a = 0 and v <> '__NULL__') as new_values,
                 count(*) filter (where b = 0 and v <> '__NULL__') as removed_values
          from (select v, a, b, p / sum(p) over () p, q / sum(q) over () q from (
             select v, a, b, case when a > 0 then a / sum(a) over () else 1e-10 end p,
                    case when b > 0 then b / sum(b) over () else 1e-10 end q
             from (select coalesce(x.v, y.v) v, coalesce(a, 0) a, coalesce(b, 0) b from
               (select coalesce(cast({c} as varchar), '__NULL__') v, count(*) a from o group by 1) x
               full join
               (select coalesce(cast({c} as varchar), '__NULL__') v, count(*) b from n group by 1) y
               on x.v = y.v)))""")
    return f"with {HALVES_SQL} " + " union all ".join(parts)


@query("drift_js", "QB-03", js_sql(["event_type"]))
def drift_js(t):
    return drift.distribution_drift(*halves(t), ["event_type"])


@query("drift_all_columns", "QB-04 QB-03", js_sql(["event_type", "props", "user_id"]))
def drift_all_columns(t):
    return drift.distribution_drift(*halves(t), ["event_type", "props", "user_id"])


@query(
    "drift_changed_values",
    "SET-03",
    f"""with {HALVES_SQL}, c as (
         select 'event_type' as column_name, 'new' as change, event_type as value,
                count(*) as row_count from n
         where event_type not in (select event_type from o) group by 3
         union all select 'event_type', 'removed', event_type, count(*) from o
         where event_type not in (select event_type from n where event_type is not null) group by 3)
       select * from c""",
)
def drift_changed_values(t):
    return drift.changed_values(*halves(t), ["event_type"])


@query(
    "value_set_difference",
    "SET-03",
    f"""with {HALVES_SQL}
       , m as (select case when user_id % 10 = 0 then user_id + 1000000 else user_id end as user_id from n)
       select cast(user_id as bigint) as value, 'new' as change from m
         where user_id not in (select user_id from o) group by 1
       union all select cast(user_id as bigint), 'removed' from o
         where user_id not in (select user_id from m) group by 1""",
)
def value_set_difference(t):
    """Both halves whole; every tenth user has another number in the second one."""
    old, new = halves(t)
    moved = F.when(F.col("user_id") % 10 == 0, F.col("user_id") + 1000000).otherwise(F.col("user_id"))
    return value_difference(old, new.withColumn("user_id", moved), "user_id")


CHANGED_SQL = """old as (select o_orderkey, o_orderstatus, o_totalprice from orders
     where o_orderkey % 20 <> 1),
   cur as (select o_orderkey, case when o_orderkey % 20 = 3 then 'X' when o_orderkey % 20 = 4
       then null else o_orderstatus end as o_orderstatus, o_totalprice
     from orders where o_orderkey % 20 <> 2)"""


def changed_orders(t):
    key = F.col("o_orderkey") % 20
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    status = F.when(key == 3, "X").when(key != 4, F.col("o_orderstatus"))
    return rows.filter(key != 1), rows.filter(key != 2).withColumn("o_orderstatus", status)


@query(
    "records_reconcile",
    "JN-12 SET-05",
    f"""with {CHANGED_SQL}
       select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey,
         case when a.o_orderkey is null then 'added' when b.o_orderkey is null then 'removed'
              when a.o_orderstatus is distinct from b.o_orderstatus
                or a.o_totalprice is distinct from b.o_totalprice then 'modified'
              else 'unchanged' end as change
       from old a full join cur b on a.o_orderkey = b.o_orderkey""",
)
def records_reconcile(t):
    return drift.reconcile(*changed_orders(t), ["o_orderkey"])


@query(
    "drift_records",
    "QB-05",
    f"""with {CHANGED_SQL}, d as (
         select case when a.o_orderkey is null then 'a' when b.o_orderkey is null then 'r'
              when a.o_orderstatus is distinct from b.o_orderstatus then 'm' else 'u' end as k
         from old a full join cur b on a.o_orderkey = b.o_orderkey),
       c as (select count(*) filter (where k = 'a') a, count(*) filter (where k = 'r') r,
               count(*) filter (where k = 'm') m, count(*) filter (where k = 'u') u from d)
       select a as added_count, r as removed_count, m as modified_count, u as unchanged_count,
         round(a * 100.0 / (m + u + a), 6) as added_percent,
         round(r * 100.0 / (m + u + r), 6) as removed_percent,
         round(m * 100.0 / (m + u + r), 6) as modified_percent from c""",
)
def drift_records(t):
    return drift.record_summary(*changed_orders(t), ["o_orderkey"])


@query(
    "baseline_capture",
    "QB-01 AGG-11 AGG-13",
    """with v as (select 'c_mktsegment' as column_name, c_mktsegment as value, count(*) as n
           from customer group by 2
         union all select 'c_name', c_name, count(*) from customer group by 2),
       r as (select *, row_number() over (partition by column_name order by n desc, value) rn from v)
       select column_name, value, n from r where rn <= 100
       union all select column_name, '__OTHER__', cast(sum(n) as bigint) from r where rn > 100
         group by column_name""",
)
def baseline_capture(t):
    return drift.distribution(t.customer, ["c_mktsegment", "c_name"]).select("column_name", "value", "n")


@query(
    "baseline_facts",
    "AGG-11 AGG-14",
    """select 'event_type' as column_name, count(*) as total_count,
         count(distinct event_type) as distinct_count, 0 as null_count from events""",
)
def baseline_facts(t):
    rows = t.events.select("event_type", "value")
    return drift.distribution_facts(rows, drift.low_cardinality_columns(rows))


@query(
    "baseline_numeric",
    "AGG-12",
    " union all ".join(
        f"""select '{c}' as column_name, min({c})::double as min, max({c})::double as max,
            round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as stddev from customer"""
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    ),
)
def baseline_numeric(t):
    stats = drift.numeric_stats(t.customer)
    return stats.withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


def _spelled(t):
    """Events whose types are the texts that stand for NULL and for the rest, beside real NULLs."""
    spelled = (
        F.when(F.col("event_type") == "click", drift.NULL_VALUE)
        .when(F.col("event_type") == "signup", drift.OTHER_VALUE)
        .when(F.col("event_type") != "error", F.col("event_type"))
    )
    return t.events.withColumn("event_type", spelled)


SPELLED_SQL = """s as (select *, case event_type when 'click' then '__NULL__' when 'signup' then '__OTHER__' when 'error' then null
     else event_type end as spelled from events)"""


@query(
    "baseline_marker_texts",
    "AGG-11 QB-01",
    f"""with {SPELLED_SQL}, c as (
         select 'event_type' as column_name, spelled as v, count(*) as n from s group by 2
         union all select 'user_id', user_id::varchar, count(*) from s group by 2),
       r as (select *, row_number() over (partition by column_name order by n desc, v nulls first) as rn from c)
       select column_name, coalesce(v, '__NULL__') as value, n, case when v is null then 'null' else 'value' end as kind from r where rn <= 100
       union all select column_name, '__OTHER__', sum(n)::bigint, 'other' from r where rn > 100 group by 1""",
)
def baseline_marker_texts(t):
    return drift.distribution(_spelled(t), ["event_type", "user_id"])


@query(
    "profile_marker_texts",
    "TOP-01",
    f"""with {SPELLED_SQL}, c as (select spelled as v, count(*) as n from s where spelled is not null group by 1)
       select 'event_type' as column_name, v as value, n as row_count, round(n / (select sum(n) from c), 4) as fraction,
              row_number() over (order by n desc, v) as rank from c""",
)
def profile_marker_texts(t):
    return frequent_values(_spelled(t), ["event_type"])


@query("baseline_checksums", "QB-01")
def baseline_checksums(t):
    return drift.record_checksums(t.customer, ["c_custkey"])


@query(
    "dq_run_over_run",
    "DQ-36 DQ-37 DQ-38 QB-06",
    f"""with {HALVES_SQL},
         c as (select (select count(*) from o) p, (select count(*) from n) q)
       select 'rows' as check_id, case when abs(q - p) * 100.0 / p <= 20 then 'passed' else 'failed'
              end as status from c
       union all select 'grown', case when (q - p) * 100.0 / p <= 0.5 then 'passed' else 'failed' end
         from c
       union all select 'types', 'failed' union all select 'users', 'passed'
       union all select 'records', 'failed'""",
)
def dq_run_over_run(t):
    old, new = halves(t)
    checks = [
        Check("row_count_change_within_percent", params={"max_change_percent": 20.0}, id="rows"),
        Check(
            "row_count_change_within_percent",
            params={"max_change_percent": 0.5, "direction": "increase"},
            id="grown",
        ),
        Check("column_distribution_stable", "event_type", {"max_divergence": 0.05}, id="types"),
        Check("column_distribution_stable", "user_id", {"max_divergence": 0.9}, id="users"),
        Check(
            "record_changes_within_limits",
            params={"key_columns": ["event_id"], "max_removed_percent": 10.0},
            id="records",
        ),
    ]
    return run_suite(new, checks, Context(baseline=old)).select("check_id", "status")


_CHANGE = "(select (q - p) * 100.0 / p from (select (select count(*) from o) p, (select count(*) from n) q))"


@query(
    "quality_run_defaults",
    "QB-06",
    f"""with {HALVES_SQL}, grown as (select {_CHANGE} as change),
         doubled as (select (select count(*) from events) * 100.0 / (select count(*) from o) - 100 as change),
         filled as (select case when count(*) = count(event_type) then 'passed' else 'failed' end as status from n)
       select 'default' as run, 'row_count_change_within_percent' as check_id, case when abs(change) <= 20 then 'passed' else 'failed' end as status from grown
       union all select 'default', 'types', status from filled
       union all select 'default', 'left out', 'skipped'
       union all select 'default', 'later', 'pending'
       union all select 'whole', 'row_count_change_within_percent', case when abs(change) <= 20 then 'passed' else 'failed' end from doubled
       union all select 'whole', 'types', case when count(*) = count(event_type) then 'passed' else 'failed' end from events
       union all select 'none', 'types', status from filled
       union all select 'own', 'rows', case when change >= -1 then 'passed' else 'failed' end from grown
       union all select 'first', 'row_count_change_within_percent', 'skipped'
       union all select 'first', 'types', status from filled""",
)
def quality_run_defaults(t):
    """The default check beside configured ones, with more rows, switched off, configured, and without an earlier run."""
    old, new = halves(t)
    filled = Check("column_values_to_not_be_null", "event_type", id="types")
    idle = [Check("column_values_to_be_unique", "event_id", severity="skip", id="left out"), Check(PENDING, id="later")]
    own = Check("expect_row_count_change_within_percent", params={"direction": "decrease", "max_change_percent": 1.0}, id="rows")
    runs = {
        "default": run_checks(new, [filled, *idle], Context(baseline=old)),
        "whole": run_checks(t.events, [filled], Context(baseline=old)),
        "none": run_checks(new, [replace(filled, tags=("skip_defaults",))], Context(baseline=old)),
        "own": run_checks(new, [own], Context(baseline=old)),
        "first": run_checks(new, [filled]),
    }
    parts = [rows.select(F.lit(name).alias("run"), "check_id", "status") for name, rows in runs.items()]
    return reduce(DataFrame.unionAll, parts)


@query(
    "quality_run_history",
    "SNK-08 QB-08",
    """with r as (
         select 1 as i, count(*) as n, count(*) filter (where l_quantity > 45) as bad, max(l_tax) as tax from lineitem
         union all select 2, count(*), count(*) filter (where l_quantity > 40), max(l_tax) from lineitem),
       c as (
         select i, 'quantity' as check_id, 'expect_column_values_to_be_between' as expectation_type, 'l_quantity' as column_name, bad = 0 as success,
                'critical' as severity, true as blocking, bad as unexpected_count, round(bad * 100.0 / n, 6) as unexpected_percent, '["load"]' as tags, n from r
         union all select i, 'tax', 'expect_column_max_to_be_between', 'l_tax', tax <= 1, 'warning', false, null, null, '[]', n from r)
       select 'run-' || i as run_id, '2024-03-0' || i as run_date, check_id, expectation_type, column_name, success, severity, blocking, unexpected_count,
              unexpected_percent, tags, 2 as total_checks, (count(*) filter (where success) over (partition by i))::int as passed_checks,
              bool_or(blocking and not success) over (partition by i) as should_block, i = 2 as incremental_mode, n as validated_records, 28 as n_columns
       from c""",
)
def quality_run_history(t):
    """Two runs of a suite written to the typed history, a day each, and read back."""
    path = scratch_path(t.spark, "quality-history")
    for i, most in ((1, 45), (2, 40)):
        checks = [
            Check("column_values_to_be_between", "l_quantity", {"max_value": most}, severity="critical", blocking=True, id="quantity",
                  tags=("load",), description="bounded"),
            Check("column_max_to_be_between", "l_tax", {"max_value": 1}, id="tax"),
            Check("column_values_to_be_unique", "l_orderkey", severity="skip", id="left out"),
        ]
        run = Run(f"run-{i}", f"2024-03-0{i} 06:00:00", "daily", "lineitem", since="2024-01-01 00:00:00" if i == 2 else None,
                  validated_records=t.lineitem.count())
        append_history(history_rows(run_checks(t.lineitem, checks), run, checks), path)
    found = read_history(t.spark, path, table="lineitem", pipeline="daily", from_date="2024-03-01")
    return found.select(
        "run_id", "run_date", "check_id", "expectation_type", "column_name", "success", "severity", "blocking", "unexpected_count", "unexpected_percent",
        "tags", "total_checks", "passed_checks", "should_block", "incremental_mode", "validated_records", F.lit(len(found.columns)).alias("n_columns"))
