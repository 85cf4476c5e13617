"""Joins, referential checks and derived tables."""

from pyspark.sql import functions as F

from tidewright.operators.aggregates import (
    Measure,
    distinct_tuples,
    duplicate_groups,
    duplicate_summary,
    pre_aggregate,
)
from tidewright.operators.joins import (
    KeyPair,
    bridge_aggregate,
    enrich,
    first_record,
    fk_coverage,
    discover_foreign_keys,
    measure_foreign_keys,
    orphans,
)
from tidewright.operators.ranking import latest_row
from tidewright.operators.sets import key_universe
from tidewright.operators.survivorship import Candidate, by_priority, default_only, greatest
from tidewright.plans.derive import Joined, Newest, Summarised, derive
from tidewright.queries import query
from tidewright.specs import ColumnSpec, TableDef


def moved(key, every):
    """The key, where ``every`` divides it a negative one that no row names."""
    return F.when(F.col(key) % every == 0, -F.col(key) - 1).otherwise(F.col(key))


@query(
    "join_left_enrich",
    "JN-01 PRJ-02",
    """select o.*, c.c_name as customer__c_name, c.c_mktsegment as customer__c_mktsegment
       from orders o left join (select * from customer where c_custkey % 10 <> 0) c
         on o.o_custkey = c.c_custkey""",
)
def join_left_enrich(t):
    """Every customer, every tenth under a number that no order names."""
    known = t.customer.withColumn("c_custkey", moved("c_custkey", 10))
    return enrich(t.orders, known, {"o_custkey": "c_custkey"}, "customer", ["c_name", "c_mktsegment"])


@query(
    "join_inner_filtered",
    "JN-02 JN-03 FLT-02",
    """select o.o_orderkey, o.o_totalprice, c.c_name as customer__c_name
       from orders o join customer c on o.o_custkey = c.c_custkey
         and c.c_mktsegment = 'BUILDING' and upper(c.c_name) <> 'no customer here'""",
)
def join_inner_filtered(t):
    base = t.orders.select("o_orderkey", "o_totalprice", "o_custkey")
    return enrich(
        base,
        t.customer,
        {"o_custkey": "c_custkey"},
        "customer",
        ["c_name"],
        how="inner",
        where="c_mktsegment = 'BUILDING' AND upper(c_name) <> 'no customer here'",
    ).drop("o_custkey")


@query(
    "join_left_filtered",
    "JN-03 FLT-02",
    """select o.o_orderkey, c.c_name as customer__c_name
       from orders o left join customer c on o.o_custkey = c.c_custkey and c.c_acctbal < 0""",
)
def join_left_filtered(t):
    base = t.orders.select("o_orderkey", "o_custkey")
    return enrich(
        base, t.customer, {"o_custkey": "c_custkey"}, "customer", ["c_name"], where="c_acctbal < 0"
    ).drop("o_custkey")


@query(
    "join_multi_instance",
    "JN-04",
    """select l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_partkey,
              cn.n_name as buyer_nation__n_name, sn.n_name as seller_nation__n_name
       from lineitem l join orders o on l.l_orderkey = o.o_orderkey
         join customer c on o.o_custkey = c.c_custkey
         join supplier s on l.l_suppkey = s.s_suppkey
         left join nation cn on c.c_nationkey = cn.n_nationkey and cn.n_regionkey = 1
         left join nation sn on s.s_nationkey = sn.n_nationkey""",
)
def join_multi_instance(t):
    base = t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    rows = enrich(base, t.orders, {"l_orderkey": "o_orderkey"}, "orders", ["o_custkey"], "inner")
    rows = enrich(
        rows, t.customer, {"orders__o_custkey": "c_custkey"}, "buyer", ["c_nationkey"], "inner"
    )
    rows = enrich(rows, t.supplier, {"l_suppkey": "s_suppkey"}, "seller", ["s_nationkey"], "inner")
    rows = enrich(
        rows,
        t.nation,
        {"buyer__c_nationkey": "n_nationkey"},
        "buyer_nation",
        ["n_name"],
        where="n_regionkey = 1",
    )
    rows = enrich(
        rows, t.nation, {"seller__s_nationkey": "n_nationkey"}, "seller_nation", ["n_name"]
    )
    return rows.select(*base.columns, "buyer_nation__n_name", "seller_nation__n_name")


@query(
    "join_key_override",
    "JN-05",
    """select s.s_suppkey, s.s_name, c.n as same_nation__customers from supplier s
       left join (select c_nationkey, count(*) n from customer group by 1) c
         on s.s_nationkey = c.c_nationkey""",
)
def join_key_override(t):
    per_nation = pre_aggregate(t.customer, ["c_nationkey"], [Measure("customers", "count(*)")])
    rows = enrich(
        t.supplier, per_nation, {"s_nationkey": "c_nationkey"}, "same_nation", ["customers"]
    )
    return rows.select("s_suppkey", "s_name", "same_nation__customers")


@query(
    "join_lookup_bridge",
    "JN-06",
    """select s_nationkey, count(*) as line_count,
              cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as revenue
       from lineitem join supplier on l_suppkey = s_suppkey group by s_nationkey""",
)
def join_lookup_bridge(t):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return bridge_aggregate(
        t.lineitem,
        t.supplier,
        "l_suppkey",
        "s_suppkey",
        "s_nationkey",
        [],
        partial=[F.count(F.lit(1)).alias("n"), F.sum(price).alias("p")],
        combine=[
            F.sum("n").alias("line_count"),
            F.sum("p").cast("double").alias("revenue"),
        ],
    )


@query(
    "join_first_record",
    "JN-07",
    """select c.c_custkey, f.o_orderkey as first_order__o_orderkey,
              f.o_orderpriority as first_order__o_orderpriority,
              d.o_orderkey as first_default__o_orderkey
       from customer c
       left join (select *, row_number() over (partition by o_custkey
                    order by o_orderdate, o_orderkey) rn from orders) f
         on f.o_custkey = c.c_custkey and f.rn = 1
       left join (select *, row_number() over (partition by o_custkey
                    order by o_orderkey) rn from orders) d
         on d.o_custkey = c.c_custkey and d.rn = 1""",
)
def join_first_record(t):
    base = t.customer.select("c_custkey")
    on = {"c_custkey": "o_custkey"}
    rows = first_record(
        base,
        t.orders,
        on,
        "first_order",
        ["o_orderkey", "o_orderpriority"],
        order_by=["o_orderdate asc", "o_orderkey asc"],
    )
    return first_record(rows, t.orders.drop("o_orderstatus"), on, "first_default", ["o_orderkey"])


@query(
    "fk_orphans",
    "JN-10 DQ-20",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem
       where l_orderkey not in (select o_orderkey from orders where o_orderkey % 97 <> 0)""",
)
def fk_orphans(t):
    parents = t.orders.withColumn("o_orderkey", moved("o_orderkey", 97))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return orphans(rows, parents, {"l_orderkey": "o_orderkey"})


@query(
    "fk_coverage",
    "JN-11",
    """select count(*) as keyed_rows, count(*) filter (where l_suppkey % 7 <> 0) as matched_rows,
              count(*) filter (where l_suppkey % 7 = 0) as orphan_rows,
              round(count(*) filter (where l_suppkey % 7 <> 0) / count(*), 6) as coverage
       from lineitem""",
)
def fk_coverage_query(t):
    parents = t.supplier.withColumn("s_suppkey", moved("s_suppkey", 7))
    return fk_coverage(t.lineitem, parents, {"l_suppkey": "s_suppkey"})


_PAIRS = [
    KeyPair("lineitem", "l_orderkey", "orders", "o_orderkey"),
    KeyPair("lineitem", "l_partkey", "part", "p_partkey"),
    KeyPair("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    KeyPair("orders", "o_custkey", "customer", "c_custkey"),
    KeyPair("customer", "c_nationkey", "nation", "n_nationkey"),
    KeyPair("part", "p_partkey", "supplier", "s_suppkey"),
    KeyPair("labels", "doc_id", "documents", "doc_id"),
]


def _pair_sql(p: KeyPair, likeness: str) -> str:
    return f"""select '{p.child}' as child_table, '{p.child_column}' as child_column,
        '{p.parent}' as parent_table, '{p.parent_column}' as parent_column,
        cast({likeness} as double) as name_score, cv as child_values, pv as parent_values,
        sv as shared_values, round(sv / cv, 6) as inclusion,
        case when mp > 1 then 'N:M' when mc > 1 then '1:N' when sv < pv then '1:0..1'
             else '1:1' end as cardinality
      from (select count(distinct {p.child_column}) cv from {p.child}),
           (select count(distinct {p.parent_column}) pv from {p.parent}),
           (select count(*) sv from (select distinct {p.child_column} from {p.child}
              where {p.child_column} in (select {p.parent_column} from {p.parent}))),
           (select max(n) mc from (select count(*) n from {p.child} group by {p.child_column})),
           (select max(n) mp from (select count(*) n from {p.parent} group by {p.parent_column}))"""


@query(
    "fk_discovery",
    "JN-16",
    " union all ".join(
        _pair_sql(p, score) for p, score in zip(_PAIRS, ["1", "1", "1", "1", "1", "0", "1"])
    ),
)
def fk_discovery(t):
    tables = {p.child for p in _PAIRS} | {p.parent for p in _PAIRS}
    return measure_foreign_keys({name: getattr(t, name) for name in tables}, _PAIRS)


_KEY_COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_type p_size",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus",
}


@query(
    "fk_search",
    "JN-16",
    "with vals as ("
    + " union all ".join(
        f"""select '{t}' as tab, '{c}' as col, typeof(any_value({c})) = 'VARCHAR' as text, {c}::varchar as v, count(*) as n
            from {t} where {c} is not null group by {c}"""
        for t, names in _KEY_COLUMNS.items()
        for c in names.split()
    )
    + """), facts as (select tab, col, count(*) as values, max(n) as most from vals group by all),
       shared as (select a.tab as child_table, a.col as child_column, b.tab as parent_table, b.col as parent_column, count(*) as shared_values
                  from vals a join vals b on a.v = b.v and a.text = b.text and (a.tab, a.col) <> (b.tab, b.col) group by all)
       select child_table, child_column, parent_table, parent_column, c.values as child_values, p.values as parent_values, shared_values,
              case when c.most > 1 then '1:N' when shared_values < p.values then '1:0..1' else '1:1' end as cardinality
       from shared join facts c on c.tab = child_table and c.col = child_column join facts p on p.tab = parent_table and p.col = parent_column
       where shared_values = c.values and p.most = 1""",
)
def fk_search(t):
    """Every column whose values all lie in a unique column, among all whole-number and text columns of seven tables."""
    found = discover_foreign_keys({name: getattr(t, name) for name in _KEY_COLUMNS})
    return found.select(
        "child_table", "child_column", "parent_table", "parent_column", "child_values", "parent_values", "shared_values", "cardinality")


CUSTOMER_GOLD = TableDef(
    "customer_gold",
    (
        ColumnSpec("custkey", "INTEGER", bits=64, nullable=False),
        ColumnSpec("segment", "VARCHAR"),
        ColumnSpec("order_count", "INTEGER", bits=64),
        ColumnSpec("urgent_count", "INTEGER", bits=64),
        ColumnSpec("distinct_days", "INTEGER", bits=64),
        ColumnSpec("spend", "DOUBLE"),
        ColumnSpec("last_status", "VARCHAR"),
        ColumnSpec("priority_of_dearest", "VARCHAR"),
        ColumnSpec("best_amount", "DOUBLE"),
        ColumnSpec("tier", "VARCHAR", default="standard"),
        ColumnSpec("note", "VARCHAR"),
    ),
    primary_key=("custkey",),
)

PREAGG_GOLD_SQL = """
  with u as (select c_custkey as custkey from customer where c_custkey % 4 <> 0
             union select o_custkey from orders),
   a as (select o_custkey, count(*) as order_count,
           count(case when o_orderpriority = '1-URGENT' then 1 end) as urgent_count,
           count(distinct o_orderdate) as distinct_days,
           cast(sum(cast(o_totalprice as decimal(18,2))) as double) as spend,
           arg_max(o_orderpriority, (o_totalprice, o_orderkey)) as dearest
         from orders group by 1),
   l as (select * from (select *, row_number() over (partition by o_custkey
           order by o_orderdate desc, o_orderkey desc) rn from orders where o_totalprice > 1000)
         where rn = 1)
  select u.custkey, coalesce(nullif(c.c_mktsegment, ''), 'UNKNOWN') as segment,
     a.order_count, a.urgent_count, a.distinct_days, a.spend, l.o_orderstatus as last_status,
     a.dearest as priority_of_dearest,
     coalesce(greatest(c.c_acctbal, l.o_totalprice), -1) as best_amount,
     'standard' as tier, cast(null as varchar) as note
  from u left join customer c on u.custkey = c.c_custkey
     left join a on u.custkey = a.o_custkey left join l on u.custkey = l.o_custkey"""


@query(
    "preagg_gold",
    "AGG-01 AGG-02 AGG-03 WIN-03 JN-09 SUR-01 SUR-02 SUR-03 SUR-04 SUR-05 SET-01 FLT-01 PRJ-03",
    PREAGG_GOLD_SQL,
)
def preagg_gold(t):
    named = t.customer.withColumn("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey")))
    base = key_universe([(named, "c_custkey"), (t.orders, "o_custkey")], "custkey")
    on = {"custkey": "o_custkey"}
    steps = [
        Joined(t.customer, "c", {"custkey": "c_custkey"}, ["c_mktsegment", "c_acctbal"]),
        Summarised(
            t.orders,
            "o",
            on,
            [
                Measure("order_count", "count(*)"),
                Measure("urgent", "count(case when o_orderpriority = '1-URGENT' then 1 end)"),
                Measure("days", "count(distinct o_orderdate)"),
                Measure("spend", "sum(cast(o_totalprice as decimal(18,2)))"),
                Measure("dearest", "max_by(o_orderpriority, struct(o_totalprice, o_orderkey))"),
            ],
        ),
        Newest(
            t.orders,
            "last",
            on,
            ["o_orderdate", "o_orderkey"],
            ["o_orderstatus", "o_totalprice"],
            where="o_totalprice > 1000",
        ),
    ]
    c = F.col
    mapping = {
        "custkey": c("custkey"),
        "segment": by_priority([Candidate(c("c__c_mktsegment"), "customer", 1)], "UNKNOWN", "string"),
        "order_count": c("o__order_count"),
        "urgent_count": c("o__urgent"),
        "distinct_days": c("o__days"),
        "spend": c("o__spend"),
        "last_status": c("last__o_orderstatus"),
        "priority_of_dearest": c("o__dearest"),
        "best_amount": greatest(
            [
                Candidate(c("c__c_acctbal"), "customer"),
                Candidate(c("last__o_totalprice"), "orders"),
            ],
            -1,
            "double",
        ),
        "note": default_only("string"),
    }
    return derive(base, steps, CUSTOMER_GOLD, mapping)


@query(
    "project_namespaced_gold",
    "PRJ-01 PRJ-02 PRJ-03 PRJ-05 PRJ-07",
    """select o.o_orderkey as orderkey, upper(c.c_mktsegment) as segment,
         o.o_totalprice * 2 as total, null::varchar as remark,
         o.o_orderkey % 5 as meta_source_offset, c.c_custkey % 3 as customer__meta_load
       from orders o left join customer c on o.o_custkey = c.c_custkey""",
)
def project_namespaced_gold(t):
    from tidewright.operators.project import override, required_columns

    base = t.orders.withColumn("meta_source_offset", F.col("o_orderkey") % 5)
    base = required_columns(base, ["o_custkey", "o_totalprice"], key="o_orderkey")
    base = override(base, {"o_totalprice": "o_totalprice * 2"})
    other = t.customer.withColumn("meta_load", F.col("c_custkey") % 3)
    spec = TableDef(
        "gold",
        (
            ColumnSpec("orderkey", "INTEGER", bits=64),
            ColumnSpec("total", "DOUBLE"),
            ColumnSpec("segment"),
            ColumnSpec("remark"),
        ),
    )
    steps = [Joined(other, "customer", {"o_custkey": "c_custkey"}, ["c_mktsegment"])]
    mapping = {
        "orderkey": F.col("o_orderkey"),
        "total": F.col("o_totalprice"),
        "segment": F.upper("customer__c_mktsegment"),
    }
    return derive(base, steps, spec, mapping, sort_names=True)


@query(
    "latest_row_aggregate",
    "WIN-03",
    """select user_id, event_type, value from (select *, row_number() over (
         partition by user_id order by ts desc, event_id desc) rn
         from events where event_type <> 'error') where rn = 1""",
)
def latest_row_aggregate(t):
    return latest_row(
        t.events, ["user_id"], ["ts", "event_id"], ["event_type", "value"], "event_type <> 'error'"
    )


@query(
    "agg_verbatim_expressions",
    "AGG-02 AGG-03",
    """select l_returnflag, count(distinct l_suppkey) as suppliers,
         round(avg(l_quantity), 6) as mean_quantity,
         arg_min(l_orderkey, (l_shipdate, l_orderkey)) as first_shipped,
         cast(max(case when l_discount > 0.05 then l_extendedprice end) as double) as top_discounted,
         count(*) filter (where l_tax = 0) as untaxed
       from lineitem group by 1""",
)
def agg_verbatim_expressions(t):
    return pre_aggregate(
        t.lineitem,
        ["l_returnflag"],
        [
            Measure("suppliers", "count(distinct l_suppkey)"),
            Measure("mean_quantity", "round(avg(l_quantity), 6)"),
            Measure("first_shipped", "min_by(l_orderkey, struct(l_shipdate, l_orderkey))"),
            Measure("top_discounted", "max(case when l_discount > 0.05 then l_extendedprice end)"),
            Measure("untaxed", "count(*)", where="l_tax = 0"),
        ],
    )


_UNIQUE_SQL = """select '{n}' as tuple_name, count(*) as row_count,
    (select count(*) from (select distinct {c} from lineitem)) as distinct_count,
    count(*) = (select count(*) from (select distinct {c} from lineitem)) as is_unique
    from lineitem"""


@query(
    "key_uniqueness",
    "AGG-09",
    _UNIQUE_SQL.format(n="order_line", c="l_orderkey, l_linenumber")
    + " union all "
    + _UNIQUE_SQL.format(n="order_part", c="l_orderkey, l_partkey")
    + " union all "
    + _UNIQUE_SQL.format(n="order_part_supplier", c="l_orderkey, l_partkey, l_suppkey"),
)
def key_uniqueness(t):
    tuples = {
        "order_line": ["l_orderkey", "l_linenumber"],
        "order_part": ["l_orderkey", "l_partkey"],
        "order_part_supplier": ["l_orderkey", "l_partkey", "l_suppkey"],
    }
    parts = [
        distinct_tuples(t.lineitem, cols).select(F.lit(n).alias("tuple_name"), "*")
        for n, cols in tuples.items()
    ]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query(
    "duplicate_groups",
    "AGG-10",
    """select l_orderkey, l_linenumber, count(*) as group_size from lineitem
       group by 1, 2 having count(*) > 1""",
)
def duplicate_groups_query(t):
    return duplicate_groups(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "duplicate_group_summary",
    "AGG-10",
    """select count(*) as duplicate_groups, cast(sum(n) as bigint) as duplicate_rows,
         max(n) as largest_group
       from (select count(*) n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""",
)
def duplicate_group_summary(t):
    return duplicate_summary(t.lineitem, ["l_orderkey", "l_linenumber"])
