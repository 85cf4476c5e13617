"""Casts of dirty text, rendered from the given tables by expression."""

from pyspark.sql import functions as F

from tidewright.functions import casts
from tidewright.queries import query
from tidewright.specs import ColumnSpec, TableDef

LINE_NO = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(
    "cast_numeric_dirty",
    "CST-02 CST-03 CST-04 CST-05",
    """with d as (select l_orderkey, l_linenumber, l_partkey, l_suppkey,
              cast(l_extendedprice as decimal(18,2)) as price, cast(l_quantity as int) as qty,
              (l_orderkey + l_linenumber) % 7 as kind from lineitem)
       select l_orderkey, l_linenumber, l_partkey, l_suppkey,
              cast(case kind when 3 then null when 5 then null else price end as double) as price,
              case kind when 2 then null when 4 then null else qty end as qty,
              case kind when 3 then null else cast(qty as double) * 1000 end as weight,
              cast(case when qty >= 10 then null else qty end as double) as small
       from d""",
)
def cast_numeric_dirty(t):
    kind = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(7))
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    qty = F.col("l_quantity").cast("int").cast("string")
    raw = t.lineitem.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.when(kind == 3, "")
        .when(kind == 5, F.concat(F.lit("1,"), price))
        .when(kind == 1, F.concat(F.lit("$"), price))
        .otherwise(F.concat(F.lit(" $"), price, F.lit(" ")))
        .alias("price"),
        F.when(kind == 2, F.concat(qty, F.lit(".5")))
        .when(kind == 4, "n/a")
        .otherwise(F.concat(F.lit(" "), qty))
        .alias("qty"),
        F.when(kind == 3, "notnum").otherwise(F.concat(qty, F.lit("E3"))).alias("weight"),
        F.concat(qty, F.lit(".00")).alias("small"),
    )
    spec = TableDef(
        "dirty",
        (
            ColumnSpec("l_orderkey", "INTEGER", bits=64),
            ColumnSpec("l_linenumber", "INTEGER"),
            ColumnSpec("l_partkey", "INTEGER", bits=64),
            ColumnSpec("l_suppkey", "INTEGER", bits=64),
            ColumnSpec("price", "DECIMAL", precision=18, scale=2),
            ColumnSpec("qty", "INTEGER"),
            ColumnSpec("weight", "DOUBLE"),
            ColumnSpec("small", "DECIMAL", precision=3, scale=2),
        ),
    )
    out = casts.cast_table(raw, spec)
    return out.withColumns({c: F.col(c).cast("double") for c in ("price", "small")})


def five_ways():
    return F.pmod("o_orderkey", F.lit(5))


def rendered_dates(t):
    def as_text(pattern):
        return F.date_format("o_orderdate", pattern)

    return t.orders.select(
        "o_orderkey",
        F.when(five_ways() == 0, as_text("yyyy-MM-dd"))
        .when(five_ways() == 1, as_text("MM/dd/yyyy"))
        .when(five_ways() == 2, as_text("yyyyMMdd"))
        .when(five_ways() == 3, as_text("M/d/yyyy"))
        .otherwise(as_text("MM/dd/yyyy HH:mm:ss"))
        .alias("d"),
    )


RENDERED = """select o_orderkey, o_orderdate, case o_orderkey % 5
         when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%m/%d/%Y')
         when 2 then strftime(o_orderdate, '%Y%m%d')
         when 3 then month(o_orderdate) || '/' || day(o_orderdate) || '/' || year(o_orderdate)
         else strftime(o_orderdate, '%m/%d/%Y %H:%M:%S') end as d from orders"""


@query(
    "cast_dates_multiformat",
    "CST-07 CST-12",
    f"""with r as ({RENDERED})
       select o_orderkey,
         cast(case when regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}}') then o_orderdate end
              as timestamp) as iso_only,
         cast(case when regexp_full_match(d, '\\d{{2}}/\\d{{2}}/\\d{{4}}') then o_orderdate end
              as timestamp) as us_padded,
         cast(case when regexp_full_match(d, '\\d{{8}}') then o_orderdate end
              as timestamp) as compact,
         cast(o_orderdate as timestamp) as any_format
       from r""",
)
def cast_dates_multiformat(t):
    d = F.col("d")
    return rendered_dates(t).select(
        "o_orderkey",
        casts.parse_with(d, "YYYY-MM-DD").alias("iso_only"),
        casts.parse_with(d, "MM/DD/YYYY").alias("us_padded"),
        casts.parse_with(d, "YYYYMMDD").alias("compact"),
        casts.flexible_timestamp(
            d, "YYYY-MM-DD", ["MM/DD/YYYY", "YYYYMMDD", "M/D/YYYY", "MM/DD/YYYY HH:MM:SS"]
        ).alias("any_format"),
    )


@query(
    "cast_epoch_excel",
    "CST-09 CST-10 CST-11",
    """select event_id, date_trunc('second', ts) as from_epoch,
              date_trunc('millisecond', ts) as from_epoch_millis,
              strftime(ts, '%Y-%m-%d') as from_serial,
              date_trunc('day', ts) + interval 6 hour as from_serial_time
       from events""",
)
def cast_epoch_excel(t):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    day = F.datediff(F.col("ts"), F.lit("1899-12-30").cast("date"))
    raw = t.events.select(
        "event_id",
        F.floor(micros / 1000).cast("bigint").cast("string").alias("ms"),
        day.cast("string").alias("serial"),
        F.concat(day.cast("string"), F.lit(".25")).alias("serial_time"),
    )
    return raw.select(
        "event_id",
        casts.from_epoch_ms(F.col("ms")).alias("from_epoch"),
        casts.from_epoch_ms(F.col("ms"), millis=True).alias("from_epoch_millis"),
        casts.from_serial_date(F.col("serial")).cast("string").alias("from_serial"),
        casts.from_serial_datetime(F.col("serial_time")).alias("from_serial_time"),
    )


@query(
    "date_format_inference",
    "CST-19",
    f"""with r as ({RENDERED}), f(format, preference, rx) as (values
          ('YYYY-MM-DD', 0, '\\d{{4}}-\\d{{2}}-\\d{{2}}'), ('YYYY/MM/DD', 1, '\\d{{4}}/\\d{{2}}/\\d{{2}}'),
          ('MM/DD/YYYY', 2, '\\d{{2}}/\\d{{2}}/\\d{{4}}'), ('MM-DD-YYYY', 3, '\\d{{2}}-\\d{{2}}-\\d{{4}}'),
          ('M/D/YYYY', 4, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}'), ('YYYYMMDD', 5, '\\d{{8}}'),
          ('MM/DD/YYYY HH:MM:SS', 10, '\\d{{2}}/\\d{{2}}/\\d{{4}} \\d{{2}}:\\d{{2}}:\\d{{2}}'))
       select 'd' as column_name, format, count(*) as non_null,
              count(*) filter (where regexp_full_match(d, rx)) as parsed
       from r cross join f group by format""",
)
def date_format_inference(t):
    hits = casts.format_hits(rendered_dates(t), ["d"])
    tried = [
        "YYYY-MM-DD",
        "YYYY/MM/DD",
        "MM/DD/YYYY",
        "MM-DD-YYYY",
        "M/D/YYYY",
        "YYYYMMDD",
        "MM/DD/YYYY HH:MM:SS",
    ]
    return hits.filter(F.col("format").isin(tried)).select(
        "column_name", "format", "non_null", "parsed"
    )


@query(
    "date_format_suggestion",
    "CST-19",
    f"""with r as ({RENDERED})
       select 'd' as column_name, 'M/D/YYYY' as format,
              round(count(*) filter (where regexp_full_match(d, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}'))
                    / count(*), 6) as share from r""",
)
def date_format_suggestion(t):
    return casts.suggest_format(rendered_dates(t), ["d"])


@query(
    "cast_passthrough_typed_bool",
    "CST-01 CST-06 CST-20",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag,
         case l_returnflag when 'A' then true when 'N' then false end as flag,
         cast(l_partkey as int) as part_int, cast(l_tax as double) as tax,
         strftime(l_shipdate, '%Y-%m-%d') as ship_day
       from lineitem""",
)
def cast_passthrough_typed_bool(t):
    flag = F.col("l_returnflag")
    raw = t.lineitem.select(
        *LINE_NO.split(", "),
        "l_returnflag",
        F.when(flag == "A", " True").when(flag == "N", "f").otherwise("maybe").alias("flag"),
        F.col("l_partkey").alias("part_int"),
        F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("ship_day"),
    )
    spec = TableDef(
        "typed",
        (
            *[ColumnSpec(c, "INTEGER", bits=64) for c in ("l_orderkey", "l_partkey", "l_suppkey")],
            ColumnSpec("l_linenumber", "INTEGER"),
            ColumnSpec("l_returnflag", "CHAR"),
            ColumnSpec("flag", "BOOLEAN"),
            ColumnSpec("part_int", "INTEGER"),
            ColumnSpec("tax", "FLOAT"),
            ColumnSpec("ship_day", "DATE"),
        ),
    )
    return casts.cast_table(raw, spec).withColumn("ship_day", F.col("ship_day").cast("string"))


@query(
    "cast_flexible",
    "CST-08 CST-13 CST-14",
    """select o_orderkey,
         case when o_orderkey % 5 = 4 then null else strftime(o_orderdate, '%Y-%m-%d') end
           as day_found,
         case when o_orderkey % 5 = 4 then null
              else o_orderdate end as time_found,
         case when o_orderkey % 5 in (0, 3) then o_orderdate end as iso_found
       from orders""",
)
def cast_flexible(t):
    day = F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date"))
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    raw = t.orders.select(
        "o_orderkey",
        F.when(five_ways() == 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(five_ways() == 1, day.cast("string"))
        .when(five_ways() == 2, F.date_format("o_orderdate", "M/d/yyyy  h:mm a"))
        .when(five_ways() == 3, F.date_format("o_orderdate", " yyyy-MM-dd HH:mm:ss "))
        .otherwise("10:30:00")
        .alias("d"),
        F.when(five_ways() == 1, (micros / 1000).cast("bigint").cast("string")).alias("ms"),
    )
    d = F.col("d")
    spaced = raw.select(
        "o_orderkey",
        "d",
        casts.single_spaced(d).alias("s"),
        casts.single_spaced(F.coalesce("ms", "d")).alias("m"),
    )
    return spaced.select(
        "o_orderkey",
        casts.auto_date(F.col("s"), spaced=True).cast("string").alias("day_found"),
        casts.auto_timestamp(F.col("m"), spaced=True).alias("time_found"),
        casts.parse_default(d).alias("iso_found"),
    )
