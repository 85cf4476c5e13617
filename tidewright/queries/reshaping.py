"""Pivot, unpivot, universes and survivorship."""

from pyspark.sql import functions as F

from tidewright.operators import survivorship as sv
from tidewright.operators.reshape import pivot_join, pivot_ranked, unpivot_columns, unpivot_latest
from tidewright.operators.sets import column_difference, key_universe, union_by_name
from tidewright.queries import query

_SLOTS = ", ".join(
    f"max(case when rn = {i} then o_orderpriority end) as priority_{i}" for i in range(1, 5)
)


@query(
    "pivot_numbered",
    "RSH-01 WIN-05",
    f"""select o_custkey, {_SLOTS} from (select *, row_number() over (partition by o_custkey
          order by o_orderpriority) rn from orders) where rn <= 4 group by o_custkey""",
)
def pivot_numbered(t):
    return pivot_ranked(t.orders, ["o_custkey"], "o_orderpriority", 4, "priority")


@query(
    "pivot_join",
    "JN-08",
    f"""with p as (select o_custkey, {_SLOTS} from (select *, row_number() over (
          partition by o_custkey order by o_orderpriority) rn from (
            select * replace (o_custkey - o_custkey % 3 as o_custkey) from orders))
          where rn <= 4 group by o_custkey)
        select c_custkey, c_name, priority_1, priority_2, priority_3, priority_4
        from customer left join p on c_custkey = o_custkey""",
)
def pivot_join_query(t):
    """Every order, given to a customer whose number three divides, so that the others have none."""
    owned = t.orders.withColumn("o_custkey", F.col("o_custkey") - F.col("o_custkey") % 3)
    base = t.customer.select("c_custkey", "c_name")
    return pivot_join(base, owned, {"c_custkey": "o_custkey"}, "o_orderpriority", 4, "priority")


_UNPIVOT_SQL = " union all ".join(
    f"""select l_orderkey, l_linenumber, l_partkey, '{c}' as measure, {c} as amount
        from lineitem where {c} is not null and not ({c} = 0)"""
    for c in ("l_quantity", "l_discount", "l_tax")
)


@query("unpivot_measures", "RSH-02", _UNPIVOT_SQL)
def unpivot_measures(t):
    measures = ["l_quantity", "l_discount", "l_tax"]
    ids = ["l_orderkey", "l_linenumber", "l_partkey"]
    # a zero counts as an empty cell here, so that NULL cells do occur
    rows = t.lineitem.select(
        *ids, *[F.nullif(F.col(c), F.lit(0.0)).alias(c) for c in measures]
    )
    return unpivot_columns(rows, ids, measures, "measure", "amount")


_UNPIVOT_LATEST = " union all ".join(
    f"select o_custkey, '{c}' as fact, {e} as content from w" for c, e in (
        ("o_orderstatus", "o_orderstatus"), ("o_orderpriority", "o_orderpriority"))
)


@query(
    "unpivot_latest",
    "RSH-03 WIN-06",
    f"""with w as (select * from (select *, row_number() over (partition by o_custkey
          order by o_orderkey desc) rn from orders) where rn = 1) {_UNPIVOT_LATEST}""",
)
def unpivot_latest_query(t):
    facts = ["o_orderstatus", "o_orderpriority"]
    rows = t.orders.select("o_custkey", "o_orderkey", *facts)
    return unpivot_latest(rows, ["o_custkey"], facts, "o_orderkey", "fact", "content")


@query(
    "unpivot_latest_wide",
    "WIN-06 RSH-03",
    """select s_suppkey, 'balance' as source_column, round(s_acctbal + 1, 2) as value from supplier
         where s_suppkey % 2 = 0
       union all select s_suppkey, 'balance', s_acctbal from supplier where s_suppkey % 2 = 1
       union all select s_suppkey, 'nation', cast(s_nationkey as double) from supplier
         where s_suppkey % 2 = 1""",
)
def unpivot_latest_wide(t):
    old = t.supplier.select(
        "s_suppkey",
        F.lit("2024-01-01").cast("date").alias("loaded"),
        F.col("s_acctbal").alias("balance"),
        F.col("s_nationkey").cast("double").alias("nation"),
    )
    new = t.supplier.filter("s_suppkey % 2 = 0").select(
        "s_suppkey",
        F.lit("2024-02-01").cast("date").alias("loaded"),
        F.round(F.col("s_acctbal") + 1, 2).alias("balance"),
        F.lit(None).cast("double").alias("nation"),
    )
    return unpivot_latest(old.unionByName(new), ["s_suppkey"], ["balance", "nation"], "loaded")


@query(
    "universe_union",
    "SET-01 FLT-07",
    """select case when c_custkey % 3 = 0 then c_custkey + 10000000 else c_custkey end as custkey
         from customer where c_custkey is not null
       union select o_custkey from orders where o_custkey % 5 <> 0""",
)
def universe_union(t):
    """Every customer, some under a number that no order names; every order, some without one."""
    key = F.col("c_custkey")
    left = t.customer.withColumn("c_custkey", F.when(key % 3 == 0, key + 10000000).otherwise(key))
    right = t.orders.withColumn(
        "o_custkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey"))
    )
    return key_universe([(left, "c_custkey"), (right, "o_custkey")], "custkey")


@query(
    "union_files_by_name",
    "SET-02",
    """select c_custkey, c_name, c_mktsegment, c_acctbal from customer where c_custkey % 3 = 0
       union all by name
       select c_custkey, c_name, c_acctbal from customer where c_custkey % 3 = 1
       union all by name
       select c_custkey, c_mktsegment from customer where c_custkey % 3 = 2""",
)
def union_files_by_name(t):
    third = [t.customer.filter(f"c_custkey % 3 = {i}") for i in range(3)]
    return union_by_name(
        [
            third[0].select("c_custkey", "c_name", "c_mktsegment", "c_acctbal"),
            third[1].select("c_acctbal", "c_name", "c_custkey"),
            third[2].select("c_custkey", "c_mktsegment"),
        ]
    )


@query(
    "schema_set_diff",
    "SET-04",
    """select 'c_phone' as column_name, 'missing' as finding, 'error' as severity,
         null::bigint as value_count
       union all select 'c_nationkey', 'unexpected', 'warning', count(c_nationkey) from customer
       union all select 'c_mktsegment', 'unexpected', 'warning', count(c_mktsegment)
         from customer""",
)
def schema_set_diff(t):
    return column_difference(t.customer, ["c_custkey", "c_name", "c_phone", "c_acctbal"])


def _two_systems(t):
    """Customer facts as two systems hold them, with gaps."""
    a = t.customer.select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, "")
        .when(F.col("c_custkey") % 3 == 1, F.col("c_name"))
        .alias("name_a"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("balance_a"),
    )
    b = (
        t.orders.groupBy("o_custkey")
        .agg(
            F.max("o_totalprice").alias("balance_b"),
            F.max("o_orderdate").alias("stamp_b"),
        )
        .filter("o_custkey % 5 <> 0")
    )
    return a.join(b, F.col("c_custkey") == F.col("o_custkey"), "left")


_SYSTEMS_SQL = """with s as (select c_custkey,
      case c_custkey % 3 when 0 then '' when 1 then c_name end as name_a,
      case when c_custkey % 2 = 0 then c_acctbal end as balance_a, balance_b, stamp_b
    from customer left join (select o_custkey, max(o_totalprice) balance_b,
        max(o_orderdate) stamp_b from orders where o_custkey % 5 <> 0 group by 1)
      on c_custkey = o_custkey) """


@query(
    "survivorship_priority",
    "SUR-02",
    _SYSTEMS_SQL
    + """select c_custkey, coalesce(nullif(name_a, ''),
            nullif(case when balance_b is not null then 'orders' end, ''), 'nobody') as name from s""",
)
def survivorship_priority(t):
    from_b = F.when(F.col("balance_b").isNotNull(), "orders")
    candidates = [sv.Candidate(from_b, "b"), sv.Candidate(F.col("name_a"), "a", 1)]
    value = sv.by_priority(candidates, "nobody", "string", text=True)
    return _two_systems(t).select("c_custkey", value.alias("name"))


@query(
    "survivorship_greatest",
    "SUR-03",
    _SYSTEMS_SQL + "select c_custkey, coalesce(greatest(balance_a, balance_b), -1) as score from s",
)
def survivorship_greatest(t):
    candidates = [sv.Candidate(F.col("balance_a"), "a"), sv.Candidate(F.col("balance_b"), "b")]
    return _two_systems(t).select(
        "c_custkey", sv.greatest(candidates, -1, "double").alias("score")
    )


@query(
    "survivorship_most_recent",
    "SUR-06",
    _SYSTEMS_SQL
    + """select c_custkey, case when balance_a is null then balance_b
           when balance_b is null then balance_a
           when stamp_b > timestamp '2001-06-01' then balance_b else balance_a end as balance
         from s""",
)
def survivorship_most_recent(t):
    candidates = [
        sv.Candidate(
            F.col("balance_a"), "a", 1, F.lit("2001-06-01 00:00:00").cast("timestamp_ntz")
        ),
        sv.Candidate(F.col("balance_b"), "b", 2, F.col("stamp_b")),
    ]
    return _two_systems(t).select("c_custkey", sv.most_recent(candidates).alias("balance"))


@query(
    "survivorship_longest",
    "SUR-06",
    """select c_custkey, case when c_custkey % 4 = 0 then c_mktsegment
          when length(c_mktsegment) >= length('HOUSEHOLDS') then c_mktsegment
          else 'HOUSEHOLDS' end as label from customer""",
)
def survivorship_longest(t):
    other = F.when(F.col("c_custkey") % 4 == 0, "").otherwise("HOUSEHOLDS")
    candidates = [sv.Candidate(F.col("c_mktsegment"), "a", 1), sv.Candidate(other, "b", 2)]
    return t.customer.select("c_custkey", sv.longest(candidates).alias("label"))


@query(
    "survivorship_attribution",
    "SUR-08",
    _SYSTEMS_SQL
    + """select c_custkey, case when nullif(name_a, '') is not null then 'system_a'
            when balance_b is not null then 'system_b' end as won_by from s""",
)
def survivorship_attribution(t):
    from_b = F.when(F.col("balance_b").isNotNull(), "orders")
    candidates = [
        sv.Candidate(F.col("name_a"), "system_a", 1),
        sv.Candidate(from_b, "system_b", 2),
    ]
    return _two_systems(t).select(
        "c_custkey", sv.attribution(candidates, text=True).alias("won_by")
    )
