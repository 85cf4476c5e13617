"""Row scopes, exclusions, flags, literals and rendering."""

from pyspark.sql import functions as F

from tidewright.operators.filters import (
    exclude_matching,
    flag_matching,
    flag_rows,
    keyed,
    scoped_counts,
    since,
)
from tidewright.operators.project import map_values, null_literals
from tidewright.queries import query
from tidewright.sinks.rendering import format_outputs, render_nulls
from tidewright.specs import ColumnSpec, TableDef


@query(
    "filter_row_scope",
    "FLT-01 FLT-03 FLT-07",
    """select 'returned' as scope, count(*) filter (where l_returnflag = 'R') as row_count from lineitem
        union all select 'late', count(*) filter (where l_shipdate >= timestamp '2000-01-01') from lineitem
        union all select 'deep_discount', count(*) filter (where l_discount > 0.08 and l_quantity < 10)
          from lineitem
        union all select 'keyed', count(*) filter (where l_partkey % 11 <> 0) from lineitem
          where l_partkey % 11 <> 0""",
)
def filter_row_scope(t):
    scopes = {
        "returned": "l_returnflag = 'R'",
        "late": "l_shipdate >= timestamp_ntz'2000-01-01 00:00:00'",
        "deep_discount": "l_discount > 0.08 and l_quantity < 10",
    }
    gaps = t.lineitem.select(F.when(F.col("l_partkey") % 11 != 0, F.col("l_partkey")).alias("k"))
    return scoped_counts(t.lineitem, scopes).unionAll(
        scoped_counts(keyed(gaps, ["k"]), {"keyed": "true"})
    )


@query(
    "incremental_window",
    "FLT-04 QB-08",
    """select event_id, event_type from events
       where ts > (select max(ts) from events where event_id % 1000 = 0) and event_id % 7 <> 0""",
)
def incremental_window(t):
    from tidewright.quality.history import last_validated

    runs = t.events.filter("event_id % 1000 = 0").select(
        F.lit("events").alias("table_name"),
        F.lit("web").alias("pipeline"),
        F.col("ts").alias("run_timestamp"),
    )
    cutoff = last_validated(runs, "events", "web")
    rows = t.events.withColumn("meta_load_dt", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    bound = F.lit(cutoff).cast("timestamp_ntz")
    return since(rows, bound).select("event_id", "event_type")


@query(
    "upsert_exclusions_and_flags",
    "FLT-05 FLT-06",
    """select o_orderkey, o_custkey, o_totalprice,
         case when o_totalprice > 400000 then 'large' end as size_flag,
         case when o_custkey in (select c_custkey from customer where c_mktsegment = 'MACHINERY')
              then 'Y' end as machinery
       from orders where o_custkey not in (select c_custkey from customer where c_acctbal < 0)""",
)
def upsert_exclusions_and_flags(t):
    rows = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    on = {"o_custkey": "c_custkey"}
    rows = exclude_matching(rows, t.customer, on, "c_acctbal < 0")
    rows = flag_rows(rows, "size_flag", "large", "o_totalprice > 400000")
    return flag_matching(rows, t.customer, on, "machinery", "Y", "c_mktsegment = 'MACHINERY'")


@query(
    "null_literal_and_mapping",
    "PRJ-08 PRJ-09",
    """select c_custkey, case when c_custkey % 4 = 0 then null else c_mktsegment end as segment,
         case when c_custkey % 4 = 0 then ' null ' else c_mktsegment end as raw_segment,
         case when c_custkey % 4 = 0 then null when c_mktsegment = 'BUILDING' then 'B'
              when c_mktsegment = 'MACHINERY' then 'M' else 'other' end as code,
         c_nationkey * 10 + 1 as nation_code
       from customer""",
)
def null_literal_and_mapping(t):
    text = F.when(F.col("c_custkey") % 4 == 0, " null ").otherwise(F.col("c_mktsegment"))
    rows = t.customer.select(
        "c_custkey", text.alias("segment"), text.alias("raw_segment"), "c_nationkey"
    )
    rows = null_literals(rows, preserve=["raw_segment"])
    known = F.when(F.col("segment").isNotNull(), "other")
    return rows.select(
        "c_custkey",
        "segment",
        "raw_segment",
        map_values(F.col("segment"), {"BUILDING": "B", "MACHINERY": "M"}, known).alias("code"),
        F.expr("c_nationkey * 10 + 1").alias("nation_code"),
    )


@query(
    "output_format_nulls",
    "SNK-06 SNK-07",
    """select o_orderkey, strftime(o_orderdate, '%m/%d/%Y') as o_orderdate,
         case when o_orderstatus = 'P' then 'N/A' else o_orderstatus end as o_orderstatus,
         case when o_orderkey % 6 = 0 then '-' else strftime(o_orderdate, '%Y%m%d') end as ship_day
       from orders""",
)
def output_format_nulls(t):
    rows = t.orders.select(
        "o_orderkey",
        "o_orderdate",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderdate").cast("date")).alias("ship_day"),
    )
    spec = TableDef(
        "out",
        (
            ColumnSpec("o_orderkey", "INTEGER", bits=64),
            ColumnSpec("o_orderdate", "DATETIME", format="MM/DD/YYYY"),
            ColumnSpec("o_orderstatus", null_output="N/A"),
            ColumnSpec("ship_day", "DATE", format="YYYYMMDD", null_output="-"),
        ),
    )
    return render_nulls(format_outputs(rows, spec), spec)
