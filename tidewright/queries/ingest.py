"""Raw text to typed tables, upserts and file merges."""

from pyspark.sql import functions as F

from tidewright.functions.casts import parse_with
from tidewright.operators.ranking import merge_winners
from tidewright.plans.ingest import apply_batches, typed_batch, upsert_last_batch, upsert_newest
from tidewright.queries import query
from tidewright.specs import ColumnSpec, TableDef

ORDERS_SPEC = TableDef(
    "orders_by_customer",
    (
        ColumnSpec("o_custkey", "INTEGER", bits=64, nullable=False),
        ColumnSpec("o_orderkey", "INTEGER", bits=64),
        ColumnSpec("o_orderstatus", "CHAR", length=1),
        ColumnSpec("o_totalprice", "DECIMAL", precision=18, scale=2),
        ColumnSpec("o_orderdate", "DATETIME", format="MM/DD/YYYY HH:MM:SS"),
    ),
    primary_key=("o_custkey",),
    mode="incremental",
    order_by=("o_orderdate", "o_orderkey"),
)


def raw_orders(t):
    """Orders as a delimited file would land them: all text, currency marks, US dates."""
    return t.orders.select(
        F.col("o_custkey").cast("string").alias("o_custkey"),
        F.concat(F.lit(" "), F.col("o_orderkey").cast("string")).alias("o_orderkey"),
        "o_orderstatus",
        F.concat(F.lit(" $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias(
            "o_totalprice"
        ),
        F.date_format("o_orderdate", "MM/dd/yyyy HH:mm:ss").alias("o_orderdate"),
    )


def shown(df):
    return df.withColumn("o_totalprice", F.col("o_totalprice").cast("double"))


@query(
    "ingest_dedup_latest",
    "WIN-01 CST-21 CST-02 CST-03 CST-04 CST-07",
    """select o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate from (
         select *, row_number() over (partition by o_custkey
                                      order by o_orderdate desc, o_orderkey desc) rn from orders)
       where rn = 1""",
)
def ingest_dedup_latest(t):
    return shown(typed_batch(raw_orders(t), ORDERS_SPEC))


def _batches(t):
    raw = raw_orders(t)
    part = F.pmod(F.trim("o_orderkey").cast("bigint"), F.lit(3))
    return [typed_batch(raw.filter(part == i), ORDERS_SPEC) for i in range(3)]


@query(
    "ingest_upsert_last_batch",
    "SNK-01 STR-04",
    """select o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate from (
         select *, row_number() over (partition by o_custkey
              order by o_orderkey % 3 desc, o_orderdate desc, o_orderkey desc) rn from orders)
       where rn = 1""",
)
def ingest_upsert_last_batch(t):
    first, second, third = _batches(t)
    keys = ORDERS_SPEC.primary_key
    return shown(upsert_last_batch(upsert_last_batch(first, second, keys), third, keys))


@query(
    "ingest_upsert_newest",
    "SNK-01 STR-03 STR-04",
    """select o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate from (
         select *, row_number() over (partition by o_custkey
              order by o_orderdate desc, o_orderkey desc) rn from orders)
       where rn = 1""",
)
def ingest_upsert_newest(t):
    first, second, third = _batches(t)
    keys, order = ORDERS_SPEC.primary_key, ORDERS_SPEC.order_by
    return shown(upsert_newest(upsert_newest(third, first, keys, order), second, keys, order))


@query(
    "ingest_batches_one_ranking",
    "SNK-01 STR-04",
    """select o_custkey, o_orderkey, o_orderstatus, o_totalprice, o_orderdate from (
         select *, row_number() over (partition by o_custkey
              order by o_orderkey % 3 desc, o_orderdate desc, o_orderkey desc) rn from orders)
       where rn = 1""",
)
def ingest_batches_one_ranking(t):
    return shown(apply_batches(_batches(t), ORDERS_SPEC.primary_key, ORDERS_SPEC.order_by))


@query(
    "file_merge_winner",
    "SUR-07 WIN-02 WIN-04",
    """with s as (
         select o_custkey, o_orderkey, o_orderkey % 3 as source_index, o_orderdate as seen,
                o_orderdate + to_days(cast(o_orderkey % 40 as int)) as changed from orders),
       m as (select *, (case when seen = max(seen) over (partition by o_custkey) then 1 else 0 end)
                     + (case when changed = max(changed) over (partition by o_custkey)
                        then 1 else 0 end) as merge_score from s),
       r as (select *, row_number() over (partition by o_custkey
                order by merge_score desc, source_index, o_orderkey) rn from m)
       select o_custkey, o_orderkey, cast(source_index as int) as source_index, merge_score
       from r where rn = 1""",
)
def file_merge_winner(t):
    rows = t.orders.select(
        "o_custkey",
        "o_orderkey",
        F.pmod("o_orderkey", F.lit(3)).cast("int").alias("source_index"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("seen"),
        F.date_format(
            F.date_add("o_orderdate", F.pmod("o_orderkey", F.lit(40)).cast("int")), "M/d/yyyy"
        ).alias("changed"),
    )
    stamps = {
        "seen": parse_with(F.col("seen"), "YYYY-MM-DD"),
        "changed": parse_with(F.col("changed"), "M/D/YYYY"),
    }
    won = merge_winners(rows, ["o_custkey"], stamps, "source_index", "o_orderkey", audit=True)
    return won.select("o_custkey", "o_orderkey", "source_index", "merge_score")
