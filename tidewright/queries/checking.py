"""Data-quality suites, their scores and their consequences."""

from pyspark.sql import functions as F

from tidewright.quality import scoring
from tidewright.quality.actions import split_rows, tag_violations
from tidewright.quality.spec_checks import check_table, table_errors
from tidewright.quality.suite import Context, failure_samples, run_staged, run_suite
from tidewright.queries import query
from tidewright.specs import Check, ColumnSpec, TableDef

FACTS = ["check_id", "status", "element_count", "unexpected_count"]


def counted(check_id: str, table: str, scope: str, bad: str, mostly: float = 1.0) -> str:
    """SQL of one row-level check."""
    return f"""select '{check_id}' as check_id,
        case when n = 0 or 1 - u / n >= {mostly} then 'passed' else 'failed' end as status,
        n as element_count, u as unexpected_count
      from (select count(*) filter (where {scope}) n,
                   count(*) filter (where ({scope}) and ({bad})) u from {table})"""


def literal(check_id: str, ok: str, element: str = "null", unexpected: str = "null") -> str:
    return f"""select '{check_id}' as check_id,
        case when {ok} then 'passed' else 'failed' end as status,
        cast({element} as bigint) as element_count, cast({unexpected} as bigint) as unexpected_count"""


def unite(*parts: str) -> str:
    return "\nunion all ".join(f"select * from ({p})" for p in parts)


LINE_CHECKS = [
    Check("expect_table_row_count_to_be_between", params={"min_value": 1}, id="rows"),
    Check("table_column_count_to_equal", params={"value": 11}, id="columns"),
    Check(
        "table_columns_to_match_ordered_list",
        params={"column_list": ["l_orderkey", "l_partkey", "l_linenumber"]},
        id="order",
    ),
    Check("column_values_to_be_of_type", "l_quantity", {"type_": "DoubleType"}, id="type"),
    Check("column_values_to_not_be_null", "l_orderkey", severity="critical", id="not_null"),
    Check(
        "column_values_to_be_in_set", "l_returnflag", {"value_set": ["A", "N"]}, id="set",
        blocking=True, severity="critical",
    ),
    Check(
        "column_values_to_be_between", "l_quantity", {"min_value": 2, "max_value": 40},
        id="range", mostly=0.75,
    ),
    Check(
        "column_values_to_be_between", "l_shipdate",
        {"min_value": "1995-06-01 00:00:00"}, id="late_enough",
    ),
    Check("column_values_to_match_regex", "l_linestatus", {"regex": "^[OF]$"}, id="regex"),
    Check("column_value_lengths_to_be_between", "l_returnflag", {"min_value": 1, "max_value": 1},
          id="lengths"),
    Check("column_value_lengths_to_equal", "l_linestatus", {"value": 2}, id="length", severity="info"),
    Check("column_values_to_be_unique", "l_orderkey", id="unique"),
    Check(
        "compound_columns_to_be_unique",
        params={"column_list": ["l_orderkey", "l_linenumber"]},
        id="compound",
    ),
    Check("column_pair_values_a_to_be_greater_than_b",
          params={"column_A": "l_quantity", "column_B": "l_linenumber"}, id="pair"),
    Check("column_values_to_not_be_null", "l_partkey", where="l_returnflag = 'R'", id="scoped"),
    Check("column_values_to_cast_to_type", "l_returnflag", {"target_type": "INTEGER"}, id="castable"),
    Check("accepted_values", "l_linestatus", {"value_set": ["O", "F"]}, id="accepted"),
]

DUPES = """(select coalesce(sum(n), 0) from (select count(*) n from lineitem
   group by {c} having count(*) > 1))"""
LINE_SQL = unite(
    literal("rows", "(select count(*) from lineitem) >= 1"),
    literal("columns", "true"),
    literal("order", "false"),
    literal("type", "true"),
    counted("not_null", "lineitem", "true", "l_orderkey is null"),
    counted("set", "lineitem", "l_returnflag is not null", "l_returnflag not in ('A', 'N')"),
    counted("range", "lineitem", "l_quantity is not null",
            "not (l_quantity between 2 and 40)", 0.75),
    counted("late_enough", "lineitem", "l_shipdate is not null",
            "l_shipdate < timestamp '1995-06-01'"),
    counted("regex", "lineitem", "l_linestatus is not null", "l_linestatus not in ('O', 'F')"),
    counted("lengths", "lineitem", "l_returnflag is not null", "length(l_returnflag) <> 1"),
    counted("length", "lineitem", "l_linestatus is not null", "length(l_linestatus) <> 2"),
    literal("unique", DUPES.format(c="l_orderkey") + " = 0", "(select count(*) from lineitem)",
            DUPES.format(c="l_orderkey")),
    literal("compound", DUPES.format(c="l_orderkey, l_linenumber") + " = 0",
            "(select count(*) from lineitem)", DUPES.format(c="l_orderkey, l_linenumber")),
    counted("pair", "lineitem", "true", "not (l_quantity >= l_linenumber)"),
    counted("scoped", "lineitem", "l_returnflag = 'R'", "l_partkey is null"),
    counted("castable", "lineitem", "true", "true"),
    counted("accepted", "lineitem", "true", "l_linestatus not in ('O', 'F')"),
)


@query(
    "dq_suite_lineitem",
    "DQ-01 DQ-02 DQ-03 DQ-04 DQ-05 DQ-06 DQ-07 DQ-08 DQ-09 DQ-10 DQ-11 DQ-12 DQ-15 DQ-16 DQ-19 "
    "DS-01 FLT-03",
    LINE_SQL,
)
def dq_suite_lineitem(t):
    return run_suite(t.lineitem, LINE_CHECKS).select(FACTS)


STAGED_SQL = unite(
    "select 'shape' as check_id, 'raw' as stage, "
    + "case when u = 0 then 'passed' else 'failed' end as status, u as unexpected_count from "
    + "(select count(*) filter (where o_orderkey % 9 = 0) u from orders)",
    "select 'format', 'raw', case when u = 0 then 'passed' else 'failed' end, u from "
    + "(select count(*) filter (where o_orderkey % 9 = 0) u from orders)",
    "select 'dear', 'ingested', case when u = 0 then 'passed' else 'failed' end, u from "
    + "(select count(*) filter (where o_totalprice > 450000) u from orders)",
    "select 'exists', 'redundant', 'skipped', null",
    "select 'mystery', 'unknown', 'skipped', null",
)


@query("dq_staged", "DS-02 DQ-13 DQ-15", STAGED_SQL)
def dq_staged(t):
    shown = F.when(F.col("o_orderkey") % 9 == 0, F.date_format("o_orderdate", "yyyy.MM.dd"))
    raw = t.orders.select(
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        shown.otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("day"),
    )
    checks = [
        Check("column_values_to_cast_to_type", "day", {"target_type": "DATE"}, id="shape"),
        Check(
            "column_values_to_match_strftime_format",
            "day",
            {"strftime_format": "%m/%d/%Y"},
            id="format",
        ),
        Check("column_values_to_be_between", "o_totalprice", {"max_value": 450000}, id="dear"),
        Check("column_to_exist", "day", id="exists"),
        Check("no_such_check", "day", id="mystery"),
    ]
    done = run_staged(raw, t.orders, checks)
    return done.select("check_id", "stage", "status", "unexpected_count")


@query(
    "dq_catalogue_rows",
    "DQ-21 DQ-22 DQ-23 DQ-30 DQ-31 DQ-34",
    unite(
        literal("exist", "true"),
        literal("types", "true"),
        literal("match_set", "false"),
        literal("same_rows", "(select count(*) from lineitem) = (select count(*) from orders)"),
        counted("all_null", "lineitem", "true", "l_partkey is not null"),
        counted("not_in", "lineitem", "true", "l_returnflag in ('R')"),
        counted("no_digits", "lineitem", "true", "false"),
        counted("any_of", "lineitem", "true", "l_returnflag not in ('A', 'N')"),
        counted("all_of", "lineitem", "true", "l_returnflag not in ('N')"),
        counted("none_of", "lineitem", "true", "l_linestatus = 'O' or l_linestatus = 'Z'"),
        counted("pair_equal", "lineitem", "true", "l_partkey <> l_suppkey"),
        counted("in_record", "lineitem", "true",
                "l_orderkey = l_partkey or l_orderkey = l_suppkey or l_partkey = l_suppkey"),
    ),
)
def dq_catalogue_rows(t):
    flag = "l_returnflag"
    checks = [
        Check("column_to_exist", flag, id="exist"),
        Check("column_values_to_be_in_type_list", "l_tax", {"type_list": ["double"]}, id="types"),
        Check("table_columns_to_match_set", params={"column_set": [flag]}, id="match_set"),
        Check(
            "table_row_count_to_equal_other_table",
            params={"other_table_name": "orders"},
            id="same_rows",
        ),
        Check("column_values_to_be_null", "l_partkey", id="all_null"),
        Check("column_values_to_not_be_in_set", flag, {"value_set": ["R"]}, id="not_in"),
        Check("column_values_to_not_match_regex", flag, {"regex": r"\d"}, id="no_digits"),
        Check(
            "column_values_to_match_regex_list", flag, {"regex_list": ["A", "N"]}, id="any_of"
        ),
        Check(
            "column_values_to_match_regex_list",
            flag,
            {"regex_list": ["[A-Z]", "N"], "match_on": "all"},
            id="all_of",
        ),
        Check(
            "column_values_to_not_match_regex_list",
            "l_linestatus",
            {"regex_list": ["O", "Z"]},
            id="none_of",
        ),
        Check(
            "column_pair_values_to_be_equal",
            params={"column_A": "l_partkey", "column_B": "l_suppkey"},
            id="pair_equal",
        ),
        Check(
            "select_column_values_to_be_unique_within_record",
            params={"column_list": ["l_orderkey", "l_partkey", "l_suppkey"]},
            id="in_record",
        ),
    ]
    return run_suite(t.lineitem, checks, Context(tables={"orders": t.orders})).select(FACTS)


def stat(check_id: str, expr: str, low: str, high: str) -> str:
    return f"""select '{check_id}' as check_id, case when v between {low} and {high}
        then 'passed' else 'failed' end as status, round(v, 4) as observed
        from (select cast({expr} as double) v from lineitem)"""


# DuckDB's skewness is the sample form, so the population form is written from moments
SKEW = """(avg(l_extendedprice ** 3) - 3 * avg(l_extendedprice) * avg(l_extendedprice ** 2)
   + 2 * avg(l_extendedprice) ** 3) / power(var_pop(l_extendedprice), 1.5)"""


@query(
    "dq_catalogue_stats",
    "DQ-24 DQ-25 DQ-26 DQ-27 DQ-28",
    unite(
        stat("min", "min(l_quantity)", "1", "1"),
        stat("max", "max(l_quantity)", "1", "40"),
        stat("mean", "avg(l_quantity)", "20", "30"),
        stat("median", "quantile_cont(l_quantity, 0.5)", "20", "30"),
        stat("stdev", "stddev_samp(l_quantity)", "10", "20"),
        stat("sum", "sum(l_quantity)", "0", "10"),
        stat("non_null", "count(l_tax) / count(*)", "1", "1"),
        stat("distinct", "count(distinct l_suppkey)", "1", "1000000"),
        stat("share", "count(distinct l_partkey) / count(*)", "0.5", "1"),
        stat("skew", SKEW, "-0.5", "0.5").replace("round(v, 4)", "round(v, 2)"),
        """select 'contains', case when count(distinct l_returnflag) filter (
             where l_returnflag in ('A', 'Q')) = 2 then 'passed' else 'failed' end, null
           from lineitem""",
        "select 'in_distinct', 'passed', null",
        """select 'mode', case when v in (7, 8) then 'passed' else 'failed' end,
             cast(v as double) from (select l_linenumber v from lineitem group by 1
             order by count(*) desc, 1 limit 1)""",
        """select 'quantiles', case when q[1] between 1 and 20 and q[2] between 20 and 30
             then 'passed' else 'failed' end, null
           from (select quantile_cont(l_quantity, [0.25, 0.5]) q from lineitem)""",
    ),
)
def dq_catalogue_stats(t):
    def between(kind, column, low, high, name, **more):
        return Check(f"column_{kind}_to_be_between", column,
                     {"min_value": low, "max_value": high, **more}, id=name)

    q = "l_quantity"
    checks = [
        between("min", q, 1, 1, "min"),
        between("max", q, 1, 40, "max"),
        between("mean", q, 20, 30, "mean"),
        between("median", q, 20, 30, "median", exact=True),
        between("stdev", q, 10, 20, "stdev"),
        between("sum", q, 0, 10, "sum"),
        between("proportion_of_non_null_values", "l_tax", 1, 1, "non_null"),
        between("unique_value_count", "l_suppkey", 1, 1000000, "distinct"),
        between("proportion_of_unique_values", "l_partkey", 0.5, 1, "share"),
        between("skewness", "l_extendedprice", -0.5, 0.5, "skew"),
        Check("column_distinct_values_to_contain_set", "l_returnflag", {"value_set": ["A", "Q"]},
              id="contains"),
        Check("column_distinct_values_to_be_in_set", "l_returnflag",
              {"value_set": ["A", "N", "R"]}, id="in_distinct"),
        Check("column_most_common_value_to_be_in_set", "l_linenumber", {"value_set": [7, 8]},
              id="mode"),
        Check("column_quantile_values_to_be_between", q,
              {"quantile_ranges": {"quantiles": [0.25, 0.5], "value_ranges": [[1, 20], [20, 30]]}},
              id="quantiles"),
    ]
    done = run_suite(t.lineitem, checks)
    number = F.when(F.col("check_id") != "quantiles", F.col("observed_value").cast("double"))
    number = F.when(F.col("check_id") == "skew", F.round(number, 2)).otherwise(number)
    return done.select("check_id", "status", number.alias("observed"))


@query(
    "dq_kl_divergence",
    "DQ-29",
    """select 'kl' as check_id, case when d <= 0.01 then 'passed' else 'failed' end as status,
         round(d, 6) as observed
       from (select sum(p * ln(p / w)) d from (
           select count(*) / (select count(*) from events) p,
             case event_type when 'view' then 0.3 when 'click' then 0.1 else 0.2 end w
           from events group by event_type))""",
)
def dq_kl_divergence(t):
    partition = {"view": 0.3, "click": 0.1, "signup": 0.2, "error": 0.2, "purchase": 0.2}
    check = Check(
        "column_kl_divergence_to_be_less_than",
        "event_type",
        {"partition": partition, "threshold": 0.01},
        id="kl",
    )
    done = run_suite(t.events, [check])
    return done.select(
        "check_id", "status", F.col("observed_value").cast("double").alias("observed")
    )


def _steps_sql(name: str, test: str) -> str:
    return f"""select '{name}' as check_id, case when u = 0 then 'passed' else 'failed' end as status,
        n as element_count, u as unexpected_count
      from (select count(*) n, count(*) filter (where {test}) u from (
        select value, lag(value) over (order by ts, event_id) p from events))"""


@query(
    "dq_monotonic",
    "DQ-32",
    unite(
        _steps_sql("rising", "value < p"),
        _steps_sql("falling", "value >= p"),
        literal("in_time", "true", "(select count(*) from events)", "0"),
        literal("no_order", "false"),
    ),
)
def dq_monotonic(t):
    order = {"order_by": ["ts", "event_id"]}
    events = t.events.withColumn("seconds", F.unix_micros(F.col("ts").cast("timestamp")))
    checks = [
        Check("column_values_to_be_increasing", "value", order, id="rising"),
        Check("column_values_to_be_decreasing", "value", {**order, "strictly": True}, id="falling"),
        Check("column_values_to_be_increasing", "seconds", order, id="in_time"),
        Check("column_values_to_be_increasing", "value", id="no_order"),
    ]
    return run_suite(events, checks).select(FACTS)


@query(
    "dq_complete_periods",
    "DQ-35",
    """with d as (select distinct cast(o_orderdate as date) d from orders
               where not (day(o_orderdate) = 13)),
         cal as (select unnest(generate_series(min(d), max(d), interval 1 day))::date c from d)
       select 'days' as check_id, case when count(d.d) = count(*) then 'passed' else 'failed' end
                as status, count(*) as element_count, count(*) - count(d.d) as unexpected_count
       from cal left join d on cal.c = d.d
       union all select 'months', 'passed', (select count(distinct date_trunc('month', d)) from d), 0""",
)
def dq_complete_periods(t):
    rows = t.orders.filter(F.dayofmonth("o_orderdate") != 13)
    kind = "date_column_to_have_complete_periods"
    checks = [
        Check(kind, "o_orderdate", id="days"),
        Check(kind, "o_orderdate", {"period": "month"}, id="months"),
    ]
    return run_suite(rows, checks).select(FACTS)


@query(
    "dq_embedding",
    "DQ-10 DQ-14 EMB-05",
    unite(
        counted("size", "embeddings", "true", "vec_id % 50 = 0 or vec_id % 70 = 1"),
        counted("other_size", "embeddings", "true", "true"),
        literal("mult16", "true"),
    ),
)
def dq_embedding(t):
    holed = F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 63)).otherwise(
        F.when(
            F.col("vec_id") % 70 == 1,
            F.transform("embedding", lambda x, i: F.when(i == 5, F.lit(float("nan"))).otherwise(x)),
        ).otherwise(F.col("embedding"))
    )
    rows = t.embeddings.select("vec_id", holed.cast("array<float>").alias("embedding"))
    checks = [
        Check("column_value_lengths_to_equal", "embedding", {"value": 64}, id="size"),
        Check("column_value_lengths_to_equal", "embedding", {"value": 32}, id="other_size"),
        Check("embedding_dimension_multiple_of_16_advisory", "embedding", {"dimension": 64},
              id="mult16"),
    ]
    return run_suite(rows, checks).select(FACTS)


@query(
    "dq_json",
    "DQ-33",
    unite(
        counted("parseable", "events", "true", "event_id % 8 = 0"),
        counted("schema", "events", "true", "event_id % 8 = 0 or event_id % 8 = 1"),
        counted("as_text", "events", "true", "event_id % 8 <> 1"),
    ),
)
def dq_json(t):
    text = (
        F.when(F.col("event_id") % 8 == 0, F.expr("substr(props, 2)"))
        .when(F.col("event_id") % 8 == 1, F.lit('{"k": "x"}'))
        .otherwise(F.col("props"))
    )
    rows = t.events.select("event_id", text.alias("props"))

    def typed(kind):
        return {"json_schema": {"required": ["k"], "properties": {"k": {"type": kind}}}}

    checks = [
        Check("column_values_to_be_json_parseable", "props", id="parseable"),
        Check("column_values_to_match_json_schema", "props", typed("integer"), id="schema"),
        Check("column_values_to_match_json_schema", "props", typed("string"), id="as_text"),
    ]
    return run_suite(rows, checks).select(FACTS)


QUARANTINE = [
    Check("column_values_to_not_be_null", "o_custkey", blocking=True, id="key"),
    Check("column_values_to_be_in_set", "o_orderstatus", {"value_set": ["O", "F"]}, id="status"),
    Check("column_values_to_be_between", "o_totalprice", {"min_value": 5000}, id="price",
          severity="info"),
]


@query(
    "dq_quarantine",
    "DS-09",
    """select o_orderkey,
         case when o_orderkey % 500 = 0 then 'FAIL' when o_orderstatus not in ('O', 'F') then 'DROP'
              when o_totalprice < 5000 then 'WARN' end as action,
         concat_ws(',', case when o_orderkey % 500 = 0 then 'key' end,
           case when o_orderstatus not in ('O', 'F') then 'status' end,
           case when o_totalprice < 5000 then 'price' end) as violations
       from orders""",
)
def dq_quarantine(t):
    gaps = F.when(F.col("o_orderkey") % 500 != 0, F.col("o_custkey"))
    tagged = tag_violations(t.orders.withColumn("o_custkey", gaps), QUARANTINE)
    return tagged.select(
        "o_orderkey",
        F.col("_action").alias("action"),
        F.array_join("_violations", ",").alias("violations"),
    )


@query(
    "dq_split_rows",
    "DS-09",
    """select case when o_orderkey % 500 = 0 then 'fatal' when o_orderstatus = 'P' then 'quarantined'
              else 'clean' end as part, count(*) as row_count from orders group by 1""",
)
def dq_split_rows(t):
    gaps = F.when(F.col("o_orderkey") % 500 != 0, F.col("o_custkey"))
    split = split_rows(t.orders.withColumn("o_custkey", gaps), QUARANTINE)

    def size(df, part):
        return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(part).alias("part"), "*")

    return (
        size(split.clean, "clean")
        .unionAll(size(split.quarantined, "quarantined"))
        .unionAll(size(split.fatal, "fatal"))
    )


SCORED_SQL = f"""with r as ({LINE_SQL}),
    s as (select r.*, case check_id when 'not_null' then 'critical' when 'set' then 'critical'
              when 'length' then 'info' else 'warning' end as severity, check_id = 'set' as blocking
          from r)
  select count(*) as total_checks, count(*) filter (where status = 'passed') as passed_checks,
    count(*) filter (where status = 'failed') as failed_checks,
    count(*) filter (where status = 'failed' and severity = 'critical') as critical_failures,
    count(*) filter (where status = 'failed' and severity = 'warning') as warning_failures,
    count(*) filter (where status = 'failed' and severity = 'info') as info_failures,
    count(*) filter (where status = 'failed' and blocking) as blocking_failures,
    round(count(*) filter (where status = 'passed') * 100.0 / count(*), 6) as success_rate,
    round(count(*) filter (where status = 'passed') * 100.0 / count(*), 6) < 90
      as threshold_breached,
    count(*) filter (where status = 'failed' and blocking) > 0
      or round(count(*) filter (where status = 'passed') * 100.0 / count(*), 6) < 90 as should_block
  from s"""


@query("quality_score_gate", "AGG-15 QB-07", SCORED_SQL)
def quality_score_gate(t):
    scored = scoring.score(run_suite(t.lineitem, LINE_CHECKS))
    gated = scoring.gate(scored, scoring.Thresholds(min_success_rate=90.0))
    return gated.select(
        "total_checks",
        "passed_checks",
        "failed_checks",
        "critical_failures",
        "warning_failures",
        "info_failures",
        "blocking_failures",
        "success_rate",
        "threshold_breached",
        "should_block",
    )


@query(
    "dq_report",
    "DS-08",
    f"""with r as ({LINE_SQL})
      select count(*) filter (where status = 'passed') as passed,
        count(*) filter (where status = 'failed') as failed,
        (select string_agg(check_id, ',' order by check_id) from r where status = 'failed') as failures,
        true as blocked,
        count(*) filter (where status = 'passed') || '/' || count(*) || ' checks passed, '
          || count(*) filter (where status = 'failed') || ' failed, 0 pending, 0 skipped' as summary
      from r""",
)
def dq_report(t):
    out = scoring.report(run_suite(t.lineitem, LINE_CHECKS))
    return out.select("passed", "failed", "failures", "blocked", "summary")


@query(
    "dq_pending_fail_closed",
    "DQ-39 DS-01",
    """select 'later' as check_id, 'pending' as status, null::bigint as element_count,
              null::bigint as unexpected_count
       union all select 'nonsense', 'failed', null, null
       union all select 'no_column', 'failed', null, null
       union all select 'no_parameter', 'failed', null, null
       union all select 'bad_scope', 'failed', null, null
       union all select 'fine', 'passed', (select count(*) from orders), 0""",
)
def dq_pending_fail_closed(t):
    checks = [
        Check("expect_validation_rule_pending_implementation", id="later"),
        Check("expect_the_impossible", "o_orderkey", id="nonsense"),
        Check("column_values_to_not_be_null", "o_nothing", id="no_column"),
        Check("column_values_to_be_in_set", "o_orderstatus", id="no_parameter"),
        Check("column_values_to_not_be_null", "o_orderkey", where="nowhere = 1", id="bad_scope"),
        Check("column_values_to_not_be_null", "o_orderkey", id="fine"),
    ]
    return run_suite(t.orders, checks).select(FACTS)


@query(
    "dq_schema_tests",
    "DQ-19 DQ-20",
    unite(
        counted("status", "orders", "true", "o_orderstatus = 'P'"),
        counted("customer", "orders", "true",
                "o_custkey not in (select c_custkey from customer where c_acctbal >= 0)"),
    ),
)
def dq_schema_tests(t):
    checks = [
        Check("accepted_values", "o_orderstatus", {"value_set": ["O", "F"]}, id="status"),
        Check(
            "relationship",
            "o_custkey",
            {"parent": "solvent", "parent_column": "c_custkey"},
            id="customer",
        ),
    ]
    tables = {"solvent": t.customer.filter("c_acctbal >= 0")}
    return run_suite(t.orders, checks, Context(tables=tables)).select(FACTS)


PHONE = """case c_custkey % 4 when 0 then '555-01' || lpad(cast(c_custkey % 100 as varchar), 2, '0')
    when 1 then lpad(cast(c_custkey % 1000000 as varchar), 10, '5')
    when 2 then '(212) 555-' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') end"""


@query(
    "dq_dates_and_domains",
    "DQ-17 DQ-18 DQ-34 DS-04 DOM-05",
    unite(
        counted("year", "orders", "true", "year(o_orderdate) <> 1998"),
        counted("period:start_day:end_day", "orders", "true", "o_orderkey % 12 = 5"),
        counted("parse", "orders", "true", "o_orderkey % 10 = 3"),
        counted("phone", "orders", "o_orderkey % 4 <> 3", "o_orderkey % 4 = 0"),
        counted("zip", "orders", "true", "o_orderkey % 3 = 2"),
        literal("unknown_domain", "false"),
    ),
)
def dq_dates_and_domains(t):
    from tidewright.quality.spec_checks import pair_checks

    key = F.col("o_orderkey")
    rows = t.orders.select(
        "o_orderdate",
        F.col("o_orderdate").cast("date").alias("start_day"),
        F.date_add("o_orderdate", F.when(key % 12 == 5, -1).otherwise(3)).alias("end_day"),
        F.when(key % 10 == 3, "yesterday")
        .when(key % 10 < 5, F.date_format("o_orderdate", "M/d/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
        .alias("when_text"),
        F.when(key % 4 == 0, "555-0100")
        .when(key % 4 == 1, F.lpad((key % 1000000).cast("string"), 10, "5"))
        .when(key % 4 == 2, F.concat(F.lit("(212) 555-"), F.lpad((key % 10000).cast("string"), 4, "0")))
        .alias("phone"),
        F.when(key % 3 == 0, F.lpad((key % 100000).cast("string"), 5, "0"))
        .when(key % 3 == 1, "12345-6789")
        .otherwise("1234")
        .alias("zip"),
    )
    spec = TableDef("t", (ColumnSpec("start_day", "DATE"), ColumnSpec("end_day", "DATE")))
    domain = "column_values_to_match_domain_type"
    checks = [
        Check("column_date_to_be_in_current_year", "o_orderdate",
              {"reference_date": "1998-07-01"}, id="year"),
        *pair_checks(spec),
        Check("column_values_to_be_dateutil_parseable", "when_text", id="parse"),
        Check(domain, "phone", {"domain_type": "phone_number"}, id="phone"),
        Check(domain, "zip", {"domain_type": "zip_code"}, id="zip"),
        Check(domain, "zip", {"domain_type": "no_such_domain"}, id="unknown_domain"),
    ]
    return run_suite(rows, checks).select(FACTS)


LINE_SPEC = TableDef(
    "lineitem",
    (
        ColumnSpec("l_orderkey", "INTEGER", bits=64, nullable=False),
        ColumnSpec("l_linenumber", "INTEGER", nullable={"A": False, "N": True}),
        ColumnSpec("l_returnflag", "CHAR", length=1),
        ColumnSpec("l_comment", "VARCHAR", length=40),
        ColumnSpec("price_text", "DECIMAL", precision=8, scale=2),
        ColumnSpec("ship_text", "DATE", format="MM/DD/YYYY"),
    ),
    primary_key=("l_orderkey", "l_linenumber"),
    context_column="l_returnflag",
    checks=(Check("column_values_to_be_in_set", "l_returnflag", {"value_set": ["A", "N"]}, id="flags"),),
)


def _line_text(t):
    """Lines with one declared column missing, one undeclared, and some unreadable text."""
    odd = F.col("l_orderkey") % 1000 == 7
    return t.lineitem.select(
        "l_orderkey",
        F.when(~odd, F.col("l_linenumber")).alias("l_linenumber"),
        "l_returnflag",
        F.when(odd, "n/a").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string"))
        .alias("price_text"),
        F.when(odd, "1/2/1998").otherwise(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("ship_text"),
        "l_tax",
    )


ODD = "l_orderkey % 1000 = 7"
LINE_DUPES = f"""(select coalesce(sum(n), 0) from (select count(*) n from (
    select l_orderkey, case when {ODD} then null else l_linenumber end ln from lineitem)
    group by l_orderkey, ln having count(*) > 1))"""
SPEC_SQL = unite(
    literal("table_column_count_to_equal", "true"),
    literal("table_columns_to_match_ordered_list", "false"),
    counted("column_values_to_not_be_null:l_orderkey", "lineitem", "true", "false"),
    counted("column_values_to_not_be_null:l_linenumber:A", "lineitem", "l_returnflag = 'A'", ODD),
    counted("column_value_lengths_to_be_between:l_returnflag", "lineitem", "true", "false"),
    literal("column_value_lengths_to_be_between:l_comment", "false"),
    counted("column_values_to_cast_to_type:price_text", "lineitem", "true", ODD),
    counted("column_values_to_cast_to_type:ship_text", "lineitem", "true", "false"),
    counted("column_values_to_match_strftime_format:ship_text", "lineitem", "true", ODD),
    literal("compound_columns_to_be_unique", LINE_DUPES + " = 0", "(select count(*) from lineitem)",
            LINE_DUPES),
    counted("flags", "lineitem", "true", "l_returnflag = 'R'"),
)


@query("spec_check", "DS-03", SPEC_SQL)
def spec_check(t):
    return check_table(_line_text(t), LINE_SPEC).select(FACTS)


@query(
    "table_errors",
    "DS-07",
    f"""select 'missing_column' as error_type, 'error' as severity, 'l_comment' as column_name,
          'column declared' as rule, null::bigint as row_count, null::varchar as samples
        union all select 'unexpected_column', 'warning', 'l_tax', 'column not declared', null, null
        union all select 'check_failed', 'critical', 'l_linenumber',
          'column_values_to_not_be_null:l_linenumber:A', count(*), '' from lineitem
          where {ODD} and l_returnflag = 'A' having count(*) > 0
        union all select 'check_failed', 'critical', 'price_text',
          'column_values_to_cast_to_type:price_text', count(*), 'n/a' from lineitem where {ODD}
          having count(*) > 0
        union all select 'check_failed', 'warning', 'ship_text',
          'column_values_to_match_strftime_format:ship_text', count(*), '1/2/1998' from lineitem
          where {ODD} having count(*) > 0
        union all select 'check_failed', 'critical', null, 'compound_columns_to_be_unique',
          cast({LINE_DUPES} as bigint), null
        union all select 'check_failed', 'warning', 'l_returnflag', 'flags', count(*), 'R'
          from lineitem where l_returnflag = 'R'""",
)
def table_errors_query(t):
    return table_errors(_line_text(t), LINE_SPEC)


SAMPLED = [
    Check("column_values_to_be_between", "l_quantity", {"max_value": 30}, id="small"),
    Check("column_values_to_be_in_set", "l_returnflag", {"value_set": ["A"]}, id="flag"),
]


@query(
    "failure_samples_ordered",
    "TOP-03",
    """select * from (
       select 'small' as check_id, cast(l_quantity as varchar) as value, count(*) as row_count
         from lineitem where l_quantity > 30 group by 1, 2 order by 2 limit 10)
       union all select 'flag', l_returnflag, count(*) from lineitem
         where l_returnflag <> 'A' group by 1, 2""",
)
def failure_samples_ordered(t):
    return failure_samples(t.lineitem, SAMPLED, ordered=True)


@query("failure_samples", "TOP-03")
def failure_samples_query(t):
    return failure_samples(t.lineitem, SAMPLED)
