"""Schema differences and lineage over the given tables."""

from dataclasses import replace

from pyspark.sql import functions as F

from tidewright.catalog import lineage
from tidewright.catalog.schemas import (
    classify,
    column_facts,
    conform,
    key_changes,
    schema_diff,
    value_counts_of,
)
from tidewright.queries import query
from tidewright.specs import ColumnSpec, spec_of_schema


def _two_states(t):
    """The customer and part tables as they are, and as a later release declares them."""
    customer = spec_of_schema("customer", t.customer.schema, primary_key=("c_custkey",))
    part = spec_of_schema("part", t.part.schema)
    old = column_facts(t.spark, [customer, part])
    changed = []
    for c in customer.columns:
        if c.name == "c_acctbal":
            c = replace(c, type="DECIMAL", precision=18)
        if c.name == "c_mktsegment":
            c = replace(c, type="TEXT", nullable=False)
        if c.name == "c_name":
            c = replace(c, name="c_fullname", aliases=("c_name",))
        if c.name != "c_nationkey":
            changed.append(c)
    changed.append(ColumnSpec("c_phone"))
    later = replace(customer, columns=tuple(changed), primary_key=("c_custkey", "c_phone"))
    narrower = tuple(replace(c, length=10) if c.name == "p_name" else c for c in part.columns)
    new = column_facts(t.spark, [later, replace(part, columns=narrower, primary_key=("p_partkey",))])
    return old, new


@query(
    "schema_drift",
    "SCH-01 SCH-02",
    """select 'customer' as table_name, 'c_nationkey' as column_name, 'removed' as change,
         'removed' as finding, 'breaking' as severity, count(c_nationkey) as value_count from customer
       union all select 'customer', 'c_fullname', 'renamed', 'renamed', 'info', null
       union all select 'customer', 'c_acctbal', 'modified', 'type_narrowed', 'breaking',
         count(c_acctbal) from customer
       union all select 'customer', 'c_mktsegment', 'modified', 'type_widened', 'info',
         count(c_mktsegment) from customer
       union all select 'customer', 'c_mktsegment', 'modified', 'nullable_tightened', 'breaking',
         count(c_mktsegment) from customer
       union all select 'customer', 'c_phone', 'added', 'added', 'info', null
       union all select 'part', 'p_name', 'modified', 'length_narrowed', 'breaking', count(p_name)
         from part""",
)
def schema_drift(t):
    found = classify(schema_diff(*_two_states(t)))
    held = value_counts_of(t.customer, "customer").unionAll(value_counts_of(t.part, "part"))
    return found.join(held, ["table_name", "column_name"], "left")


@query(
    "schema_key_changes",
    "SCH-02",
    """select 'customer' as table_name, 'c_custkey' as old_key, 'c_custkey,c_phone' as new_key,
         'primary_key_changed' as finding, 'breaking' as severity, count(*) as row_count from customer
       union all select 'part', '', 'p_partkey', 'primary_key_added', 'warning', count(*) from part""",
)
def schema_key_changes(t):
    sizes = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
        for n, df in (("customer", t.customer), ("part", t.part))
    ]
    return key_changes(*_two_states(t)).join(sizes[0].unionAll(sizes[1]), "table_name")


@query(
    "schema_conform",
    "SCH-04",
    """select o_orderstatus, o_orderkey, cast(o_orderkey % 7 as bigint) as seven,
         o_orderdate as day, cast(null as varchar) as remark from orders""",
)
def schema_conform(t):
    rows = t.orders.select(
        "o_orderkey",
        F.col("o_orderdate").cast("date").alias("day"),
        "o_orderstatus",
        (F.col("o_orderkey") % 7).cast("int").alias("seven"),
        "o_custkey",
    )
    target = spec_of_schema("t", rows.schema)
    names = {c.name: c for c in target.columns}
    ordered = (
        names["o_orderstatus"],
        names["o_orderkey"],
        replace(names["seven"], bits=64),
        ColumnSpec("day", "TIMESTAMP"),
        ColumnSpec("remark"),
    )
    return conform(rows, replace(target, columns=ordered).schema)


def ownership(t):
    """Region to nation to customer to order, as edges between named records."""

    def edge(df, a, ka, b, kb):
        name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
        return df.select(name(a, ka).alias("src"), name(b, kb).alias("dst"))

    return (
        edge(t.nation, "r:", "n_regionkey", "n:", "n_nationkey")
        .unionAll(edge(t.customer, "n:", "c_nationkey", "c:", "c_custkey"))
        .unionAll(edge(t.orders, "c:", "o_custkey", "o:", "o_orderkey"))
    )


OWNERSHIP_SQL = """e as (select 'r:' || n_regionkey src, 'n:' || n_nationkey dst from nation
    union all select 'n:' || c_nationkey, 'c:' || c_custkey from customer
    union all select 'c:' || o_custkey, 'o:' || o_orderkey from orders)"""


@query(
    "lineage_closure",
    "LIN-01 LIN-02",
    f"""with recursive {OWNERSHIP_SQL}, p(ancestor, descendant, depth) as (
         select src, dst, 1 from e
         union all select p.ancestor, e.dst, p.depth + 1 from p join e on p.descendant = e.src)
       select ancestor, descendant, min(depth) as depth from p group by 1, 2""",
)
def lineage_closure(t):
    return lineage.closure(ownership(t))


@query(
    "lineage_column_edges",
    "LIN-01 LIN-02",
    """with recursive d(src, dst, kind) as (
         select 'customer.' || c_mktsegment, 'gold.' || c_mktsegment || '_' || c_nationkey, 'derivation' from customer group by all
         union all select 'nation.' || n_nationkey, 'customer.' || c_mktsegment, 'foreign_key'
           from customer join nation on c_nationkey = n_nationkey group by all),
       p(ancestor, descendant, depth) as (
         select src, dst, 1 from d union all select p.ancestor, d.dst, p.depth + 1 from p join d on p.descendant = d.src)
       select ancestor, descendant, min(depth) as depth, any_value(kinds) as kinds from p,
         (select string_agg(kind || ':' || n, ',' order by kind) as kinds from (select kind, count(*) as n from d group by 1))
       group by 1, 2""",
)
def lineage_column_edges(t):
    """Edges from derivations and foreign keys that the rows name, and their closure."""
    pairs = t.customer.select("c_mktsegment", F.col("c_nationkey").cast("string").alias("nation")).distinct().collect()
    derived = sorted(("customer", r[0], "gold", f"{r[0]}_{r[1]}") for r in pairs)
    keys = sorted(("customer", r[0], "nation", r[1]) for r in pairs)
    edges = lineage.edges_of(t.spark, derived, keys)
    kinds = edges.groupBy("kind").count().agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "kind", "count"))), ",").alias("kinds"))
    # one row on the right
    return lineage.closure(edges).crossJoin(F.broadcast(kinds)).select("ancestor", "descendant", "depth", "kinds")


@query(
    "lineage_levels",
    "LIN-02",
    f"""with {OWNERSHIP_SQL}, n as (select src as node from e union select dst from e)
       select node, case left(node, 1) when 'r' then 0 when 'n' then 1 when 'c' then 2 else 3 end
         as level from n""",
)
def lineage_levels(t):
    return lineage.levels(ownership(t))


@query(
    "lineage_fan_out",
    "LIN-02",
    f"with {OWNERSHIP_SQL} select src as node, count(distinct dst) as fan_out from e group by 1",
)
def lineage_fan_out(t):
    return lineage.fan_out(ownership(t))


@query(
    "lineage_impact",
    "LIN-03",
    """with n as (select n_nationkey from nation where n_regionkey = 1),
            c as (select c_custkey from customer join n on c_nationkey = n_nationkey)
       select 'r:1' as node union all select 'n:' || n_nationkey from n
       union all select 'c:' || c_custkey from c
       union all select 'o:' || o_orderkey from orders join c on o_custkey = c_custkey
         where o_orderkey % 2 = 0""",
)
def lineage_impact(t):
    changed = t.region.filter("r_regionkey = 1").select(
        F.concat(F.lit("r:"), F.col("r_regionkey").cast("string")).alias("node")
    )
    removed = t.orders.filter("o_orderkey % 2 = 1").select(
        F.concat(F.lit("o:"), F.col("o_orderkey").cast("string")).alias("node")
    )
    return lineage.impacted(ownership(t), changed, removed)


@query(
    "fk_groups",
    "LIN-04",
    """with e as (select distinct 'o:' || l_orderkey a, 'c:' || o_custkey b
                  from lineitem join orders on l_orderkey = o_orderkey)
       select a as node, b as "group" from e union select b, b from e""",
)
def fk_groups(t):
    lines = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.concat(F.lit("o:"), F.col("l_orderkey").cast("string")).alias("src"),
        F.concat(F.lit("c:"), F.col("o_custkey").cast("string")).alias("dst"),
    )
    return lineage.connected_groups(lines)
