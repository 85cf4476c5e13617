"""Synthetic rows: one per row of a given table, so that sizes follow the data."""

from pyspark.sql import functions as F

from tidewright.queries import query
from tidewright.specs import Check, ColumnSpec, TableDef
from tidewright.synth import draws
from tidewright.synth.tables import (
    Link,
    Plan,
    Reference,
    dense_index,
    generate,
    generation_order,
    numbered_rows,
    summary,
    table_sizes,
    with_forced,
)


def draw_sql(row: str, salt: int) -> str:
    """The draw of ``draws.draw`` in SQL."""
    a, b, c = draws.constants(salt)
    p, m = draws.MODULUS, draws.SECOND
    first = f"(({row} % {p}) * {a} + (({row} // {p}) % 1000003) * {m} + {b}) % {p}"
    return f"((({first}) * ({first}) + {c}) % {p} * {m} + {b}) % {p}"


def salt(column: str) -> int:
    return draws.salt_of("people", column)


PEOPLE = TableDef(
    "people",
    (
        ColumnSpec("person_id", "INTEGER", bits=64, nullable=False),
        ColumnSpec("tier", "VARCHAR"),
        ColumnSpec("age", "INTEGER", bits=64),
        ColumnSpec("visits", "INTEGER", bits=64, domain="visit_count"),
        ColumnSpec("zip", "VARCHAR", domain="zip_code"),
        ColumnSpec("phone", "VARCHAR", domain="phone_number"),
        ColumnSpec("email", "VARCHAR"),
        ColumnSpec("member", "VARCHAR", domain="member_id"),
        ColumnSpec("code", "VARCHAR"),
        ColumnSpec("joined", "VARCHAR"),
        ColumnSpec("score", "DOUBLE"),
        ColumnSpec("nick", "VARCHAR", length=4),
        ColumnSpec("twin", "INTEGER", bits=64),
        ColumnSpec("batch", "VARCHAR"),
    ),
    primary_key=("person_id",),
)
PEOPLE_PLAN = Plan(
    PEOPLE,
    checks=(
        Check("column_values_to_be_in_set", "tier", {"value_set": ["gold", "silver", "bronze"]}),
        Check("column_values_to_be_between", "age", {"min_value": 18, "max_value": 99}),
        Check("column_values_to_match_regex", "code", {"regex": r"^(AX|BY)-\d{3}[a-f]?$"}),
        Check("column_values_to_match_strftime_format", "joined", {"strftime_format": "%m/%d/%Y"}),
        Check("column_pair_values_to_be_equal", params={"column_A": "twin", "column_B": "age"}),
    ),
    null_rates={"score": 0.25},
    per_file={"batch": ["2024-01", "2024-02", "2024-03"]},
    rows_per_file=500,
)


@query(
    "synth_values",
    "GEN-04 GEN-05 GEN-07",
    f"""select c_custkey as id,
          case {draw_sql('c_custkey', salt('tier'))} % 3 when 0 then 'gold' when 1 then 'silver'
            else 'bronze' end as tier,
          {draw_sql('c_custkey', salt('age'))} % 82 + 18 as age,
          {draw_sql('c_custkey', salt('age'))} % 82 + 18 as twin,
          case when {draw_sql('c_custkey', salt('visits'))} / 2147483647.0::double < 0.8
                 then {draw_sql('c_custkey', salt('visits') + 1)} % 4
               when {draw_sql('c_custkey', salt('visits'))} / 2147483647.0::double < 0.95
                 then {draw_sql('c_custkey', salt('visits') + 1)} % 7 + 4
               else {draw_sql('c_custkey', salt('visits') + 1)} % 10 + 11 end as visits,
          case when {draw_sql('c_custkey', draws.salt_of('null', 'people', 'score'))} % 10000 >= 2500
            then round({draw_sql('c_custkey', salt('score'))} / 2147483647.0::double * 1000, 4) end as score,
          case (c_custkey // 500) % 3 when 0 then '2024-01' when 1 then '2024-02' else '2024-03' end
            as batch,
          true as shapes_fit
        from customer""",
)
def synth_values(t):
    rows = t.customer.select("c_custkey")
    # the row number comes back through the key, which is a permutation of it
    made = generate(rows, "c_custkey", PEOPLE_PLAN)
    numbers = rows.select(
        F.col("c_custkey").alias("id"),
        draws.unique_number(
            F.col("c_custkey"), draws.salt_of("key", "people", "person_id"), 9
        ).alias("person_id"),
    )
    fits = (
        F.col("zip").rlike(r"^\d{5}(-\d{4})?$")
        & F.col("phone").rlike(r"^\d{10}$")
        & F.col("email").rlike(r"^[a-z0-9]+@[a-z]+\.com$")
        & F.col("member").rlike(r"^[A-Z]{2,}\d+$")
        & F.col("code").rlike(r"^(AX|BY)-\d{3}[a-f]?$")
        & F.col("joined").rlike(r"^\d{2}/\d{2}/202[45]$")
        & (F.length("nick") <= 4)
    )
    return made.join(numbers, "person_id").select(
        "id", "tier", "age", "twin", "visits", "score", "batch", fits.alias("shapes_fit")
    )


@query(
    "synth_forced",
    "GEN-08 GEN-03",
    """select tier_known, count(*) as row_count, count(distinct id) as key_count from (
         select c_custkey as id, false as tier_known from customer where c_custkey < 5
         union all select c_custkey, true from customer where c_custkey >= 5) group by 1""",
)
def synth_forced(t):
    """The first customers are stated cases; the rest is generated."""
    forced = t.customer.filter("c_custkey < 5").select(
        (F.col("c_custkey") - 10).alias("person_id"), F.lit("special").alias("tier")
    )
    some = t.customer.filter("c_custkey >= 5").select("c_custkey")
    made = generate(some, "c_custkey", PEOPLE_PLAN).select("person_id", "tier")
    return (
        with_forced(forced, made)
        .groupBy((F.col("tier") != "special").alias("tier_known"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_distinct("person_id").alias("key_count"),
        )
    )


VISITS = TableDef(
    "visits",
    (
        ColumnSpec("visit_no", "INTEGER", bits=64, nullable=False),
        ColumnSpec("line", "INTEGER", nullable=False),
        ColumnSpec("person", "INTEGER", bits=64),
        ColumnSpec("payer", "INTEGER", bits=64),
        ColumnSpec("cost", "DECIMAL", precision=9, scale=2),
    ),
    primary_key=("visit_no", "line"),
)


def _visits(t):
    pool = dense_index(t.customer.select("c_custkey"))
    size = pool.count()
    references = (
        Reference("person", pool, "c_custkey", size, group="person"),
        Reference("payer", pool, "c_custkey", size, group="person"),
    )
    rows = t.orders.select("o_orderkey")
    return generate(rows, "o_orderkey", Plan(VISITS, references=references))


HOT = draws.salt_of("fk", "visits", "person")


@query(
    "synth_fk_skew",
    "GEN-02 GEN-03",
    f"""select count(*) as row_count, count(*) as matched_rows, count(*) as same_key,
          count(*) filter (where {draw_sql('o_orderkey', HOT)} / 2147483647.0::double < 0.8) as hot_rows
        from orders""",
)
def synth_fk_skew(t):
    pool = dense_index(t.customer.select("c_custkey"))
    made = _visits(t)
    joined = made.join(pool, F.col("person") == F.col("c_custkey"), "left")
    hot = F.floor(F.lit(pool.count()) * 0.2)
    return joined.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count("c_custkey").alias("matched_rows"),
        F.count_if(F.col("person") == F.col("payer")).alias("same_key"),
        F.count_if(F.col("index") < hot).alias("hot_rows"),
    )


@query(
    "synth_summary",
    "GEN-01 GEN-10",
    f"""with n as (select count(*) n from customer)
       select 'people' as table_name, n as row_count, n as key_count, 0 as orphan_rows from n
       union all select 'visits', count(*), count(*), 0 from orders
       union all select 'cards', cast(floor(n * 0.7) as bigint), cast(floor(n * 0.7) as bigint), 0 from n
       union all select 'notes', greatest(100, n // 10), greatest(100, n // 10), 0 from n""",
)
def synth_summary(t):
    base = t.customer.count()
    links = [Link("cards", "people", "one_to_zero_or_one"), Link("visits", "people")]
    names = ["notes", "visits", "cards", "people"]
    sizes = table_sizes(names, links, base)
    people = generate(t.customer.select("c_custkey"), "c_custkey", PEOPLE_PLAN)
    made = {"people": people, "visits": _visits(t)}
    for name in generation_order(names, links):
        if name not in made:
            spec = TableDef(name, (ColumnSpec("id"), ColumnSpec("amount", "DOUBLE")), ("id",))
            made[name] = generate(numbered_rows(t.spark, sizes[name]), "row", Plan(spec))
    made["pool"] = t.customer
    keys = {"people": ["person_id"], "visits": ["visit_no", "line"], "cards": ["id"],
            "notes": ["id"], "pool": ["c_custkey"]}
    found = summary(made, keys, [("visits", "person", "pool", "c_custkey")])
    return found.filter("table_name <> 'pool'")
