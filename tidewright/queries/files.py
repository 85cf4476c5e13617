"""Sources and sinks, over text and JSON rendered from the given tables."""

from pyspark.sql import functions as F

from tidewright.functions import canon
from tidewright.functions.naming import sanitised
from tidewright.quality.drift import capture_baseline
from tidewright.quality.history import append_runs, latest_run, read_runs
from tidewright.queries import query
from tidewright.session import scratch_path
from tidewright.sinks import writers
from tidewright.sources.dialect import Delimited
from tidewright.sources.files import (
    bare_name,
    read_delimited,
    read_json,
    read_parquet,
    read_table,
)
from tidewright.sources.headers import resolve_headers
from tidewright.sources.provenance import capture_from_name, landing_columns, with_provenance
from tidewright.specs import ColumnSpec, TableDef

CUSTOMER_SQL = "select c_custkey::varchar as c_custkey, c_name, c_mktsegment from customer"


def _customers(t):
    return t.customer.select("c_custkey", "c_name", "c_mktsegment")


@query(
    "scan_text_provenance",
    "SRC-01 SRC-05 SRC-08 SRC-11",
    """select 'csv' as source, c_custkey::varchar as c_custkey, c_name, true as has_provenance
         from customer
       union all select 'parquet', c_custkey::varchar, c_name, true from customer
       union all select 'table', c_custkey::varchar, c_name, true from customer""",
)
def scan_text_provenance(t):
    path = scratch_path(t.spark, "customer-csv")
    _customers(t).write.option("header", True).option("sep", "|").csv(path)
    how = Delimited(delimiter="|", encoding="utf8")
    landed = landing_columns(read_delimited(t.spark, path, how))
    meta = with_provenance(read_parquet(t.spark, t.path("customer")), version="1", component="land")
    view = "tidewright_customer"
    _customers(t).createOrReplaceTempView(view)

    def part(df, source, proven):
        return df.select(
            F.lit(source).alias("source"),
            F.col("c_custkey").cast("string").alias("c_custkey"),
            "c_name",
            proven.alias("has_provenance"),
        )

    from_csv = part(
        landed,
        "csv",
        F.col("_source_file").contains("customer-csv") & F.col("_load_ts").isNotNull(),
    )
    from_parquet = part(
        meta,
        "parquet",
        (F.col("meta_source_name") == "customer.parquet")
        & (F.length("meta_checksum") == 64)
        & F.col("meta_source_offset").isNotNull(),
    )
    from_table = part(read_table(t.spark, view), "table", F.lit(bare_name(f"a.b.{view}") == view))
    return from_csv.unionAll(from_parquet).unionAll(from_table)


@query(
    "dump_file_read",
    "SRC-02 SRC-03 SRC-09",
    """select c_custkey::varchar as c_custkey, c_name,
         case when c_custkey % 5 = 0 then null else c_mktsegment end as segment,
         cast(null as varchar) as remark from customer""",
)
def dump_file_read(t):
    """Many small files with preamble lines, a comment, a footer and their own record ends."""
    path = scratch_path(t.spark, "customer-dump")
    segment = (
        F.when(F.col("c_custkey") % 10 == 0, r"\N")
        .when(F.col("c_custkey") % 5 == 0, "NULL")
        .otherwise(F.col("c_mktsegment"))
    )
    rows = t.customer.select(
        F.floor(F.col("c_custkey") / 500).alias("part"),
        (F.col("c_custkey") + 10).alias("nr"),
        F.concat_ws("~", F.col("c_custkey").cast("string"), "c_name", segment, F.lit("x")).alias(
            "value"
        ),
    )
    fixed = {
        0: "generated by hand",
        1: "do not edit",
        2: " C_CustKey ~Full Name~segment~unused",
        3: "#comment",
        2**62: "end of file",
    }
    around = rows.select("part").distinct().select(
        "part", F.explode(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])).alias("nr", "value")
    )
    lines = rows.unionByName(around).repartition("part").sortWithinPartitions("part", "nr")
    lines.select("part", "value").write.partitionBy("part").option("lineSep", "||").text(path)
    how = Delimited(
        delimiter="~",
        null_value="NULL",
        null_escape=r"\N",
        comment="#",
        skip_rows=2,
        footer_rows=1,
        line_terminator="||",
    )
    spec = TableDef(
        "customer",
        (
            ColumnSpec("c_custkey", nullable=False),
            ColumnSpec("c_name", canonical="full name"),
            ColumnSpec("segment"),
            ColumnSpec("remark"),
        ),
    )
    return resolve_headers(read_delimited(t.spark, path, how), spec)


def _by_part(rows, fixed):
    """Lines (part, nr, value) with the same ``fixed`` lines, by number, in every part."""
    around = rows.select("part").distinct().select(
        "part", F.explode(F.create_map(*[F.lit(x) for kv in fixed.items() for x in kv])).alias("nr", "value")
    )
    return rows.unionByName(around).repartition("part").sortWithinPartitions("part", "nr").select("part", "value")


@query(
    "dump_quoted_read",
    "SRC-02 SRC-03 SRC-09",
    """select c_custkey::varchar as c_custkey,
         c_name || ' said: "' || c_mktsegment || '~' || c_custkey || '"' || chr(10) || '#' || chr(10) || chr(10)
           || repeat('and so on ', (c_custkey % 40)::int) as remark,
         case when c_custkey % 7 = 0 then null when c_custkey % 7 = 1 then '' else c_mktsegment end as segment,
         case when (c_custkey // 300) % 3 <> 1 then c_nationkey::varchar end as nation
       from customer""",
)
def dump_quoted_read(t):
    """Quoted cells with line breaks, delimiters and quotes, in files of three layouts; a third names fewer columns."""
    path = scratch_path(t.spark, "customer-quoted")
    key = F.col("c_custkey")
    part = F.floor(key / 300)
    said = F.concat("c_name", F.lit(' said: ""'), "c_mktsegment", F.lit("~"), key, F.lit('""\n # \n\n'), F.repeat(F.lit("and so on "), (key % 40).cast("int")))
    remark = F.concat(F.lit('"'), F.replace(said, F.lit(" # "), F.lit("#")), F.lit('"'))
    segment = F.when(key % 7 == 0, r"\N").when(key % 7 == 1, "").otherwise(F.col("c_mktsegment"))
    key, nation = key.cast("string"), F.col("c_nationkey").cast("string")
    rows = t.customer.select(
        part.alias("part"), (F.col("c_custkey") + 10).alias("nr"),
        F.when(part % 3 == 0, F.concat_ws("~", key, remark, segment, nation))
        .when(part % 3 == 1, F.concat_ws("~", remark, segment, key))
        .otherwise(F.concat_ws("~", nation, F.lit("unused"), key, segment, remark)).alias("value"),
    )
    header = F.when(F.col("part") % 3 == 0, "C_CustKey~remark~segment~nation").when(F.col("part") % 3 == 1, "Remark~SEGMENT~c_custkey")
    lines = _by_part(rows, {0: 'a preamble with "one quote~"open', 1: "header", 2**62: "end of file"})
    lines = lines.withColumn("value", F.when(F.col("value") == "header", header.otherwise("nation~unused~c_custkey~segment~remark")).otherwise(F.col("value")))
    lines.write.partitionBy("part").text(path)
    how = Delimited(delimiter="~", quote='"', skip_rows=1, footer_rows=1, comment="##")
    return read_delimited(t.spark, path, how).select("c_custkey", "remark", "segment", "nation")


@query(
    "dump_without_header",
    "SRC-02 SRC-03",
    """select c_custkey::varchar as column0, c_name as column1, case when c_custkey % 5 = 0 then null else c_mktsegment end as column2
       from customer""",
)
def dump_without_header(t):
    """Files that name nothing: the columns are numbered as wide as the first record, further cells are dropped."""
    path = scratch_path(t.spark, "customer-bare")
    segment = F.when(F.col("c_custkey") % 5 == 0, "none").otherwise(F.col("c_mktsegment"))
    rows = t.customer.select(
        F.floor(F.col("c_custkey") / 400).alias("part"), (F.col("c_custkey") + 10).alias("nr"),
        F.concat_ws(";", F.col("c_custkey").cast("string"), "c_name", segment,
                    F.when(F.col("c_custkey") % 400 == 200, F.lit("beyond"))).alias("value"),
    )
    _by_part(rows, {0: "no names follow", 2**62: "end of file"}).write.partitionBy("part").option("lineSep", "\r\n").text(path)
    how = Delimited(delimiter=";", header=False, null_value="none", skip_rows=1, footer_rows=1, line_terminator="CRLF")
    return read_delimited(t.spark, path, how)


@query(
    "scan_row_offsets",
    "SRC-11",
    """select c_custkey::varchar as c_custkey, row_number() over (partition by c_custkey // 700 order by c_custkey) - 1 as row_offset
       from customer""",
)
def scan_row_offsets(t):
    """The number of every row in its file, for text files whose rows stand in a known order."""
    path = scratch_path(t.spark, "customer-offsets")
    rows = _customers(t).withColumn("part", F.floor(F.col("c_custkey") / 700))
    rows = rows.repartition("part").sortWithinPartitions("part", "c_custkey")
    rows.write.partitionBy("part").option("header", True).option("sep", "|").csv(path)
    read = read_delimited(t.spark, path, Delimited(delimiter="|"))
    return with_provenance(read).select("c_custkey", F.col("meta_source_offset").alias("row_offset"))


@query(
    "header_resolution",
    "SRC-09",
    """select c_custkey::varchar as customer_key, c_name as full_name, cast(null as varchar) as phone
       from customer""",
)
def header_resolution(t):
    path = scratch_path(t.spark, "headers")
    delivered = t.customer.select(
        F.col("c_custkey").alias("CustomerKey"),
        F.col("c_name").alias("Full Name"),
        F.col("c_mktsegment").alias("extra column"),
    )
    delivered.write.option("header", True).option("sep", ";").csv(path)
    raw = read_delimited(t.spark, path, Delimited(delimiter=";"))
    spec = TableDef(
        "c",
        (
            ColumnSpec("customer_key", nullable=False, aliases=("customerkey",)),
            ColumnSpec("full_name", canonical="FULL NAME"),
            ColumnSpec("phone"),
        ),
    )
    return resolve_headers(raw, spec)


@query(
    "header_identifiers",
    "SRC-09",
    "select c_custkey as customer_key, c_name as full_name_pcp, c_acctbal as col_2_balance from customer",
)
def header_identifiers(t):
    return sanitised(
        t.customer.select(
            F.col("c_custkey").alias("CustomerKey"),
            F.col("c_name").alias("Full NamePCP"),
            F.col("c_acctbal").alias("2 Balance "),
        )
    )


@query(
    "json_projection",
    "SRC-06",
    """select event_id, event_type as kind, json_extract_string(props, '$.k')::bigint as k,
         round(value, 2) as amount from events""",
)
def json_projection(t):
    path = scratch_path(t.spark, "events-json")
    nested = t.events.select(
        "event_id",
        F.struct(
            F.col("event_type").alias("type"),
            F.struct(F.from_json("props", "k bigint").alias("props"), F.col("value")).alias("body"),
        ).alias("event"),
    )
    nested.write.json(path)
    paths = {
        "event_id": "event_id",
        "kind": "event.type",
        "k": "event.body.props.k",
        "amount": "event.body.value",
    }
    schema = (
        "event_id bigint, event struct<type: string, body: struct<props: struct<k: bigint>,"
        " value: double>>"
    )
    return read_json(t.spark, path, paths, schema=schema)


@query(
    "filename_columns",
    "SRC-10",
    """select c_custkey, c_nationkey::varchar as nation_code, 'customers' as feed from customer""",
)
def filename_columns(t):
    base = scratch_path(t.spark, "by-nation")
    # one folder per nation would not show in the file name, so the rows carry the folder's name
    t.customer.select("c_custkey", F.col("c_nationkey").alias("nation")).write.partitionBy(
        "nation"
    ).parquet(base)
    path = F.col("_metadata.file_path")
    rows = t.spark.read.parquet(base)
    by_path = rows.select(
        "c_custkey", F.regexp_extract(path, r"nation=(\d+)/", 1).alias("nation_code")
    )
    feed = capture_from_name(
        t.spark.read.parquet(t.path("customer")).select("c_custkey", "_metadata"),
        r"^([a-z]+)\.parquet$",
        {1: "table_name"},
    )
    joined = by_path.join(feed.select("c_custkey", "table_name"), "c_custkey")
    return joined.select(
        "c_custkey", "nation_code", F.concat("table_name", F.lit("s")).alias("feed")
    )


def _tagged(t):
    return t.orders.select(
        "o_orderkey", "o_custkey", "o_orderstatus", (F.col("o_orderkey") % 3).alias("batch")
    )


@query(
    "write_append",
    "SNK-02",
    """select o_orderkey, o_custkey, o_orderstatus, o_orderkey % 3 as batch from orders
       union all select o_orderkey, o_custkey, o_orderstatus, o_orderkey % 3 from orders
         where o_orderkey % 3 = 1""",
)
def write_append(t):
    path = scratch_path(t.spark, "append")
    rows = _tagged(t)
    for batch in (0, 1, 2, 1):
        writers.append(rows.filter(F.col("batch") == batch), path)
    return t.spark.read.parquet(path)


@query(
    "write_snapshot_latest",
    "SNK-03 TOP-05",
    """select 'latest' as kept, o_orderkey, o_orderkey % 3 as batch from orders where o_orderkey % 3 = 2
       union all select 'all', o_orderkey, o_orderkey % 3 from orders""",
)
def write_snapshot_latest(t):
    paths = [scratch_path(t.spark, "snapshot") for _ in range(2)]
    rows = _tagged(t).select("o_orderkey", "batch")
    writers.replace_snapshot(rows.filter("batch < 2"), paths[0], latest_only="batch")
    writers.replace_snapshot(rows, paths[0], latest_only="batch")
    writers.replace_snapshot(rows, paths[1])
    latest, everything = (t.spark.read.parquet(p) for p in paths)
    return latest.select(F.lit("latest").alias("kept"), "*").unionAll(
        everything.select(F.lit("all").alias("kept"), "*")
    )


@query(
    "write_partitioned_footer",
    "SNK-04 SNK-05",
    """select c_custkey || '|' || c_name || '|' || c_mktsegment as value from customer
       union all select 'c_custkey|c_name|c_mktsegment' union all select count(*)::varchar from customer""",
)
def write_partitioned_footer(t):
    path = scratch_path(t.spark, "lines")
    footer = writers.wants_footer("customer_disposition")
    writers.write_lines(writers.as_lines(_customers(t), row_count_footer=footer), path)
    return t.spark.read.text(path)


@query(
    "write_single_file_footer",
    "SNK-04 SNK-05",
    """with r as (select o_orderpriority || '|' || count(*) as value from orders group by o_orderpriority)
       select value from r union all select 'o_orderpriority|order_count'
       union all select count(*)::varchar from r""",
)
def write_single_file_footer(t):
    path = scratch_path(t.spark, "report") + ".csv"
    counts = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"))
    writers.write_single_file(counts, path, row_count_footer=True)
    return t.spark.read.text(path)


@query("export_sorted", "TOP-04", "select o_custkey, o_orderstatus, o_totalprice from orders order by all")
def export_sorted(t):
    return writers.sorted_by_all(t.orders.select("o_custkey", "o_orderstatus", "o_totalprice"))


def _runs(t):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return (
        t.events.groupBy(day.alias("run_timestamp"), F.col("event_type").alias("table_name"))
        .agg(
            F.count(F.lit(1)).alias("total_checks"),
            F.count_if(F.col("value") > 50).alias("failed_checks"),
        )
        .withColumn("pipeline", F.lit("web"))
    )


@query(
    "history_latest",
    "SNK-08 SNK-09 TOP-05 QB-08",
    """with r as (select date_trunc('day', ts)::timestamp as run_timestamp, event_type as table_name,
           count(*) as total_checks, count(*) filter (where value > 50) as failed_checks
         from events group by 1, 2)
       select table_name, run_timestamp, total_checks, failed_checks from (select *,
         row_number() over (partition by table_name order by run_timestamp desc) rn from r)
       where rn = 1""",
)
def history_latest(t):
    path = scratch_path(t.spark, "runs")
    runs = _runs(t)
    append_runs(runs.filter("day(run_timestamp) % 2 = 0"), path)
    append_runs(runs.filter("day(run_timestamp) % 2 = 1"), path)
    newest = latest_run(t.spark.read.parquet(path))
    return newest.select("table_name", "run_timestamp", "total_checks", "failed_checks")


@query(
    "history_read",
    "SNK-08",
    """select date_trunc('day', ts)::timestamp as run_timestamp, count(*) as total_checks
       from events where event_type = 'click' and ts >= timestamp '2024-01-20' group by 1""",
)
def history_read(t):
    path = scratch_path(t.spark, "runs")
    append_runs(_runs(t), path)
    found = read_runs(t.spark, path, table="click", pipeline="web", from_date="2024-01-20")
    return found.select("run_timestamp", "total_checks")


@query(
    "baseline_history",
    "SNK-09 QB-01 AGG-13",
    """select 'run-2' as run_id, count(*) as row_count, (select count(*) from orders
         where o_orderkey % 2 = 1) as record_rows from orders where o_orderkey % 2 = 1""",
)
def baseline_history(t):
    """Two captured runs; the newest one is read back."""
    path = scratch_path(t.spark, "baseline")
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    for i, stamp in ((1, "2024-01-01 00:00:00"), (2, "2024-01-02 00:00:00")):
        part = rows.filter(F.col("o_orderkey") % 2 == i - 1)
        capture_baseline(part, path, "orders", "daily", stamp, f"run-{i}", keys=["o_orderkey"])
    newest = latest_run(t.spark.read.parquet(f"{path}/rows"))
    records = t.spark.read.parquet(f"{path}/records").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("record_rows")
    )
    return newest.join(records, "run_id").select("run_id", "row_count", "record_rows")


@query("canon_fingerprint", "CAN-01 CAN-02",
       "select count(*) as row_count, true as same_after_shuffle, false as same_after_change from orders")
def canon_fingerprint(t):
    one = canon.fingerprint(t.orders)
    shuffled = canon.fingerprint(t.orders.repartition(7, "o_custkey"))
    changed = canon.fingerprint(
        t.orders.withColumn(
            "o_orderstatus",
            F.when(F.col("o_orderkey") == 3, "?").otherwise(F.col("o_orderstatus")),
        )
    )
    tagged = [
        df.select(F.lit(i).alias("i"), "row_count", F.concat_ws(":", "xor_hash", "sum_hash").alias("f"))
        for i, df in enumerate((one, shuffled, changed))
    ]
    rows = tagged[0].unionAll(tagged[1]).unionAll(tagged[2])

    def mark(i):
        return F.max(F.when(F.col("i") == i, F.col("f")))

    return rows.agg(
        F.max("row_count").alias("row_count"),
        (mark(0) == mark(1)).alias("same_after_shuffle"),
        (mark(0) == mark(2)).alias("same_after_change"),
    )


@query(
    "canon_diff",
    "CAN-02 CAN-01",
    """with a as (select o_orderkey::varchar as o_orderkey, o_orderstatus,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.000000' as o_orderdate from orders),
         b as (select o_orderkey, case when o_orderkey::bigint % 100 = 7 then 'NULL'
           else o_orderstatus end as o_orderstatus, o_orderdate from a)
       select *, 1 as surplus from (select * from a except all select * from b)
       union all select *, -1 from (select * from b except all select * from a)""",
)
def canon_diff(t):
    left = t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")
    status = F.when(F.col("o_orderkey") % 100 != 7, F.col("o_orderstatus"))
    return canon.row_differences(left, left.withColumn("o_orderstatus", status))
