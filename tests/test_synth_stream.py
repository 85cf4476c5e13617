import re

import pytest
from pyspark.sql import functions as F

from tidewright.quality.suite import run_suite
from tidewright.session import scratch_path
from tidewright.specs import Check, ColumnSpec, TableDef
from tidewright.streaming.changes import (
    StreamHalted,
    apply_changes,
    compact,
    current_state,
    quarantine_stream,
    write_changes,
)
from tidewright.streaming.landing import append_stream, read_landing
from tidewright.synth import draws
from tidewright.synth.shapes import UnsupportedPattern, matching_text
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
)


@pytest.mark.parametrize(
    "pattern",
    [r"^\d{5}$|^\d{5}-\d{4}$", r"^[A-Z][A-Z0-9]*(-[A-Z]+)*$", r"^(HMO|H\d{4})$", r"^[a-c]{2,4}x?$", r"^a\.b$"],
)
def test_generated_text_matches(spark, pattern):
    made = spark.range(300).select(matching_text(F.col("id"), 11, pattern).alias("v")).collect()
    assert all(re.match(pattern, r.v) for r in made)
    assert len({r.v for r in made}) > 1 or "b$" in pattern


def test_unsupported_pattern():
    with pytest.raises(UnsupportedPattern):
        matching_text(None, 1, r"^(?=x)y$")


def test_draws_are_uniform_and_keys_unique(spark):
    df = spark.range(20000).select(
        draws.integer(F.col("id"), 5, 0, 9).alias("d"), draws.unique_number(F.col("id"), 77, 5).alias("k")
    )
    counts = [r["count"] for r in df.groupBy("d").count().collect()]
    assert len(counts) == 10 and min(counts) > 1700 and max(counts) < 2300
    assert df.select("k").distinct().count() == 20000


def test_dense_index(spark):
    df = spark.range(0, 1000, 1, 7).filter("id % 3 = 0")
    found = sorted(r["index"] for r in dense_index(df).collect())
    assert found == list(range(334))


def test_tables_conform_to_their_checks(spark):
    spec = TableDef(
        "t",
        (ColumnSpec("id", nullable=False), ColumnSpec("lob", domain="lob"), ColumnSpec("n", "INTEGER"),
         ColumnSpec("day", "DATE"), ColumnSpec("parent")),
        primary_key=("id",),
    )
    checks = [
        Check("column_values_to_be_unique", "id"),
        Check("column_values_to_match_domain_type", "lob", {"domain_type": "lob"}),
        Check("column_values_to_be_between", "n", {"min_value": 5, "max_value": 8}),
        Check("column_values_to_not_be_null", "parent"),
    ]
    pool = dense_index(spark.range(40).select(F.concat(F.lit("P"), "id").alias("key")))
    plan = Plan(spec, checks, (Reference("parent", pool, "key", 40),), null_rates={"day": 0.5, "id": 0.9})
    made = generate(numbered_rows(spark, 2000), "row", plan)
    assert {r.status for r in run_suite(made, checks).collect()} == {"passed"}
    assert 800 < made.filter("day is null").count() < 1200
    hot = made.join(pool, made.parent == pool.key).filter("index < 8").count()
    assert 0.77 < hot / 2000 < 0.83
    facts = summary({"t": made, "p": pool}, {"t": ["id"], "p": ["key"]}, [("t", "parent", "p", "key")])
    assert {r.table_name: (r.row_count, r.key_count, r.orphan_rows) for r in facts.collect()} == {
        "t": (2000, 2000, 0), "p": (40, 40, 0)
    }


def test_sizes_and_order():
    links = [Link("b", "a", "one_to_one"), Link("c", "a", "one_to_zero_or_one"), Link("d", "b")]
    names = ["d", "c", "b", "a", "lone"]
    sizes = table_sizes(names, links, 1000)
    assert (sizes["a"], sizes["b"], sizes["c"], sizes["lone"]) == (1000, 1000, 700, 100)
    assert 1400 <= sizes["d"] <= 3500
    order = generation_order(names, links)
    assert order.index("a") < order.index("b") < order.index("d")


def land(spark, path, data):
    spark.createDataFrame(data, "k string, seq int, v string").coalesce(1).write.mode("append").parquet(path)


def test_replay_and_late_rows(spark, rows):
    landing, table, mark = (scratch_path(spark, n) for n in ("in", "table", "mark"))

    def run():
        stream = read_landing(spark, landing, "k string, seq int, v string")
        apply_changes(stream, table, mark, ["k"], ["seq"]).awaitTermination()

    land(spark, landing, [("a", 1, "old"), ("a", 2, "new"), ("b", 5, "b5")])
    run()
    land(spark, landing, [("b", 3, "late"), ("c", 1, "c1")])
    run()
    run()
    newest = current_state(spark, table, ["k"], ["seq"])
    assert rows(newest, "k", "v") == [("a", "new"), ("b", "b5"), ("c", "c1")]
    last = current_state(spark, table, ["k"], ["seq"], guard="last_batch")
    assert rows(last, "k", "v") == [("a", "new"), ("b", "late"), ("c", "c1")]
    # the same batch written again overwrites its own folder
    batch = spark.createDataFrame([("b", 3, "late"), ("c", 1, "c1")], "k string, seq int, v string")
    before = spark.read.parquet(table).count()
    for _ in range(2):
        write_changes(batch, 7, table, mark, ["k"], ["seq"])
    assert spark.read.parquet(table).count() == before + 2
    base = scratch_path(spark, "base")
    compact(spark, table, base, ["k"], ["seq"])
    assert rows(current_state(spark, base, ["k"], ["seq"]), "k", "v") == rows(newest, "k", "v")
    # a change that lands after the base was written is read beside it
    land(spark, landing, [("a", 9, "after"), ("d", 1, "d1")])
    write_changes(spark.read.parquet(landing).filter("seq = 9 or k = 'd'"), 8, table, mark, ["k"], ["seq"])
    both = current_state(spark, table, ["k"], ["seq"], base=base)
    assert rows(both, "k", "v") == [("a", "after"), ("b", "b5"), ("c", "c1"), ("d", "d1")]


def test_epochs_order_streams_without_a_clock(spark, rows):
    table = scratch_path(spark, "table")
    change = "k string, seq int, v string"
    write_changes(spark.createDataFrame([("a", 1, "of the later stream")], change), 0, table, "two", ["k"], ["seq"], epoch=1)
    write_changes(spark.createDataFrame([("a", 1, "written last")], change), 5, table, "one", ["k"], ["seq"])
    last = current_state(spark, table, ["k"], ["seq"], guard="last_batch")
    assert rows(last, "k", "v") == [("a", "of the later stream")]


def test_append_counts_files_once(spark):
    landing, out, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    land(spark, landing, [("a", 1, "x")])
    for _ in range(2):
        append_stream(read_landing(spark, landing, "k string, seq int, v string"), out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_blocking_rule_stops_the_stream(spark):
    landing, out, mark = (scratch_path(spark, n) for n in ("in", "out", "mark"))
    land(spark, landing, [(None, 1, "x"), ("a", 2, "y")])
    checks = [Check("column_values_to_not_be_null", "k", blocking=True, id="key")]
    query = quarantine_stream(read_landing(spark, landing, "k string, seq int, v string"), out, mark, checks)
    with pytest.raises(Exception, match="blocking rule"):
        query.awaitTermination()
    assert issubclass(StreamHalted, RuntimeError)
