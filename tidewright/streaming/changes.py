"""Keyed changes from a stream.

Every micro-batch is reduced to one row per key and written to a folder of its own, named by the
stream and the batch number; a batch that is replayed after a failure overwrites its own folder.
The table's state is the newest change per key, resolved when it is read, so a batch costs what
it holds and never rewrites the table. ``compact`` folds the changes into a single base from time
to time; changes that arrive later are read beside it.

Batches are ordered by the epoch of their stream, then by batch number, never by a clock. Streams
that run side by side share an epoch; one that takes the place of another is given a higher one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewright.operators.ranking import latest
from tidewright.quality.actions import DROP, FAIL, tag_violations
from tidewright.specs import Check

GUARDS = ("newest", "last_batch")
#: a base is older than every stream
BASE_EPOCH = -1
MARKS = ("_epoch", "_writer", "_batch")


class StreamHalted(RuntimeError):
    """A row broke a rule that must stop the stream."""


def writer_name(checkpoint: str) -> str:
    """A stream is known by its checkpoint: batch numbers only mean something within it."""
    return "w" + hashlib.sha256(checkpoint.encode()).hexdigest()[:12]


def _folder(path: str, checkpoint: str, batch_id: int, epoch: int = 0) -> str:
    return f"{path}/_epoch={epoch}/_writer={writer_name(checkpoint)}/_batch={batch_id}"


def write_changes(
    batch: DataFrame, batch_id: int, path: str, checkpoint: str, keys: Sequence[str],
    sequence_by: Sequence[str], epoch: int = 0,
) -> None:
    """One row per key of the batch, to the batch's own folder."""
    if epoch <= BASE_EPOCH:
        raise ValueError("an epoch starts at 0")
    rows = latest(batch, keys, sequence_by)
    rows.write.mode("overwrite").parquet(_folder(path, checkpoint, batch_id, epoch))


def apply_changes(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    keys: Sequence[str],
    sequence_by: Sequence[str],
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    epoch: int = 0,
) -> StreamingQuery:
    """Run the available input through ``write_changes``; ``prepare`` may cast and check a batch."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch) if prepare else batch
        write_changes(rows, batch_id, path, checkpoint, keys, sequence_by, epoch)

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_state(
    spark: SparkSession,
    path: str,
    keys: Sequence[str],
    sequence_by: Sequence[str],
    guard: str = "newest",
    base: str | None = None,
) -> DataFrame:
    """The table: per key the newest change by sequence, or the change of the last batch.

    With ``base``, what ``compact`` wrote there stands for the batches it has folded.
    """
    changes = spark.read.parquet(path)
    if base is not None:
        changes = _after(changes, base).unionByName(spark.read.parquet(base))
    return _resolved(changes, keys, sequence_by, guard)


def _resolved(
    changes: DataFrame, keys: Sequence[str], sequence_by: Sequence[str], guard: str
) -> DataFrame:
    if guard not in GUARDS:
        raise ValueError(f"unknown guard {guard!r}")
    arrival = ["_epoch", "_batch"]
    order = [*sequence_by, *arrival] if guard == "newest" else [*arrival, *sequence_by]
    return latest(changes, keys, order).drop(*MARKS)


def _after(changes: DataFrame, base: str) -> DataFrame:
    """The batches that the base has not folded; its positions are one row per stream."""
    folded = changes.sparkSession.read.parquet(f"{base}/_positions")
    later = changes.join(F.broadcast(folded), ["_epoch", "_writer"], "left").filter(
        F.col("_folded").isNull() | (F.col("_batch") > F.col("_folded"))
    )
    return later.select(*changes.columns)


def compact(
    spark: SparkSession,
    path: str,
    target: str,
    keys: Sequence[str],
    sequence_by: Sequence[str],
    guard: str = "newest",
) -> None:
    """Write the current state as the base of a new folder, with the last batch it has of each stream.

    State and positions come from one listing of the files, so a batch that lands meanwhile is in
    neither and ``current_state(..., base=target)`` reads it beside the base.
    """
    changes = spark.read.parquet(path)
    state = _resolved(changes, keys, sequence_by, guard)
    state.write.mode("errorifexists").parquet(f"{target}/_epoch={BASE_EPOCH}/_writer=base/_batch=0")
    last = changes.groupBy("_epoch", "_writer").agg(F.max("_batch").alias("_folded"))
    last.write.mode("errorifexists").parquet(f"{target}/_positions")


def quarantine_stream(
    stream: DataFrame, path: str, checkpoint: str, checks: Sequence[Check]
) -> StreamingQuery:
    """Clean rows and rows set aside, written by one pass into partitions of the batch's folder.

    A row that breaks a blocking rule stops the stream before the batch is written.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        tagged = tag_violations(batch, checks).persist()
        try:
            fatal = tagged.filter(F.col("_action") == FAIL)
            if fatal.count():  # reads, and so keeps, the whole batch: it is computed once
                raise StreamHalted(f"batch {batch_id} holds rows that break a blocking rule")
            outcome = F.when(F.col("_action") == DROP, "quarantined").otherwise("clean")
            rows = tagged.withColumn("_outcome", outcome).drop("_action")
            rows.write.mode("overwrite").partitionBy("_outcome").parquet(
                _folder(path, checkpoint, batch_id)
            )
        finally:
            tagged.unpersist()

    return (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def refresh_view(build: Callable[[], DataFrame], path: str) -> None:
    """A materialised view: recomputed as a whole and replaced."""
    build().write.mode("overwrite").parquet(path)
