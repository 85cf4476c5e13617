"""Streams over files written from the given tables; each must equal its batch counterpart."""

from pyspark.sql import functions as F

from tidewright.queries import query
from tidewright.session import scratch_path
from tidewright.sources.dialect import Delimited
from tidewright.sources.files import string_schema
from tidewright.specs import Check, ColumnSpec, TableDef
from tidewright.streaming.changes import (
    apply_changes,
    compact,
    current_state,
    quarantine_stream,
    refresh_view,
)
from tidewright.streaming.landing import append_stream, deduplicated, read_landing, typed_stream

EVENTS = TableDef(
    "events",
    (
        ColumnSpec("event_id", "INTEGER", bits=64),
        ColumnSpec("user_id", "INTEGER", bits=64),
        ColumnSpec("event_type"),
        ColumnSpec("value", "DOUBLE"),
        ColumnSpec("ts", "TIMESTAMP", format="YYYY-MM-DD HH:MM:SS.SSSSSS"),
    ),
)


def _as_text(t):
    return t.events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("user_id"),
        "event_type",
        F.when(F.col("event_id") % 20 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
        (F.col("event_id") % 3).alias("part"),
    )


def _landed(t, part=None):
    """The events as three delimited deliveries; or one of them."""
    path = scratch_path(t.spark, "landing")
    rows = _as_text(t)
    for i in range(3) if part is None else [part]:
        rows.filter(F.col("part") == i).drop("part").write.mode("append").options(
            header=True, sep="|"
        ).csv(path)
    return path


def _stream(t, path, files=None):
    names = [c.name for c in EVENTS.columns]
    landed = read_landing(
        t.spark, path, string_schema(names), "csv", Delimited(delimiter="|"), files
    )
    return typed_stream(landed, EVENTS)


@query(
    "stream_append",
    "SRC-12 STR-01 STR-02",
    """select event_id, user_id, event_type, case when event_id % 20 = 0 then null else value end as value,
         ts from events""",
)
def stream_append(t):
    out, mark = scratch_path(t.spark, "appended"), scratch_path(t.spark, "mark")
    append_stream(_stream(t, _landed(t), files=1), out, mark).awaitTermination()
    return t.spark.read.parquet(out)


NEWEST_SQL = """select user_id, event_id, event_type, ts from (select *, row_number() over (
    partition by user_id order by ts desc, event_id desc) rn from events) where rn = 1"""


@query("stream_apply_changes", "STR-03 STR-04 STR-07", NEWEST_SQL)
def stream_apply_changes(t):
    """Three deliveries out of order, one of them delivered again to a second stream."""
    path = scratch_path(t.spark, "changes")
    keys, order = ["user_id"], ["ts", "event_id"]
    first, again = _landed(t), _landed(t, part=1)
    for epoch, source in enumerate((first, again)):
        mark = scratch_path(t.spark, "mark")
        rows = _stream(t, source, files=1)
        apply_changes(rows, path, mark, keys, order, epoch=epoch).awaitTermination()
    state = current_state(t.spark, path, keys, order)
    return state.select("user_id", "event_id", "event_type", "ts")


@query(
    "stream_last_batch",
    "STR-04",
    """select user_id, event_id, event_type, ts from (select *, row_number() over (
         partition by user_id order by event_id % 3 desc, ts desc, event_id desc) rn from events)
       where rn = 1""",
)
def stream_last_batch(t):
    """One delivery per run of the same stream, so that the order of the batches is known."""
    path, mark = scratch_path(t.spark, "changes"), scratch_path(t.spark, "mark")
    landing = scratch_path(t.spark, "landing")
    keys, order = ["user_id"], ["ts", "event_id"]
    rows = _as_text(t)
    for i in range(3):
        rows.filter(F.col("part") == i).drop("part").write.mode("append").options(
            header=True, sep="|"
        ).csv(landing)
        apply_changes(_stream(t, landing), path, mark, keys, order).awaitTermination()
    state = current_state(t.spark, path, keys, order, guard="last_batch")
    return state.select("user_id", "event_id", "event_type", "ts")


@query("stream_compacted", "STR-03 STR-06", NEWEST_SQL)
def stream_compacted(t):
    """Two deliveries are folded into a base; the third arrives after that."""
    path, mark = scratch_path(t.spark, "changes"), scratch_path(t.spark, "mark")
    target, view = scratch_path(t.spark, "base"), scratch_path(t.spark, "view")
    keys, order = ["user_id"], ["ts", "event_id"]
    first, later = [_stream(t, _landed(t, part=part), files=1) for part in (0, 2)], _landed(t, part=1)
    for rows, epoch in zip(first, (0, 1), strict=True):
        apply_changes(rows, path, f"{mark}/{epoch}", keys, order, epoch=epoch).awaitTermination()
    compact(t.spark, path, target, keys, order)
    rows = _stream(t, later, files=1)
    apply_changes(rows, path, f"{mark}/2", keys, order, epoch=2).awaitTermination()
    refresh_view(lambda: current_state(t.spark, path, keys, order, base=target), view)
    return t.spark.read.parquet(view).select("user_id", "event_id", "event_type", "ts")


@query(
    "stream_quarantine",
    "STR-05 DS-09",
    """select event_id, case when event_id % 20 = 0 or event_type = 'error' then 'quarantined'
         else 'clean' end as outcome,
         concat_ws(',', case when event_id % 20 = 0 then 'value' end,
           case when event_type = 'error' then 'type' end) as violations from events""",
)
def stream_quarantine(t):
    path, mark = scratch_path(t.spark, "split"), scratch_path(t.spark, "mark")
    checks = [
        Check("column_values_to_not_be_null", "event_id", blocking=True, id="key"),
        Check("column_values_to_not_be_null", "value", id="value"),
        Check("column_values_to_not_be_in_set", "event_type", {"value_set": ["error"]}, id="type"),
    ]
    quarantine_stream(_stream(t, _landed(t)), path, mark, checks).awaitTermination()
    return t.spark.read.parquet(path).select(
        "event_id",
        F.col("_outcome").alias("outcome"),
        F.array_join("_violations", ",").alias("violations"),
    )


@query(
    "stream_dedup_watermark",
    "STR-08",
    "select event_id, user_id, event_type from events",
)
def stream_dedup_watermark(t):
    """Every event is delivered twice; the copy arrives within the watermark."""
    landing = scratch_path(t.spark, "twice")
    rows = t.events.select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.unionAll(rows).write.parquet(landing)
    out, mark = scratch_path(t.spark, "once"), scratch_path(t.spark, "mark")
    stream = read_landing(t.spark, landing, rows.schema)
    once = deduplicated(stream, ["event_id"], "ts", "40 days")
    append_stream(once.select("event_id", "user_id", "event_type"), out, mark).awaitTermination()
    return t.spark.read.parquet(out)
