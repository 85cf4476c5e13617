"""Where rows come from: file names, load times, offsets and checksums."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.quality.drift import record_hash

# The provenance columns a landed table may carry.
META_COLUMNS = (
    "meta_source_name",
    "meta_source_checksum",
    "meta_load_dt",
    "meta_snapshot_dt",
    "meta_source_offset",
    "meta_checksum",
    "meta_pipeline_version",
    "meta_component",
)


def landing_columns(df: DataFrame, load_time: Column | None = None) -> DataFrame:
    """Add the source file and the load time, as the landing step records them."""
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("_source_file"),
        (load_time if load_time is not None else F.current_timestamp()).alias("_load_ts"),
    )


def _row_numbers(df: DataFrame) -> tuple[DataFrame, Column]:
    """``df`` with what it needs, and the number of every row in its file, from 0.

    Parquet knows it. Elsewhere rows are counted per block and summed along the file (one row per block); a row's number
    is its block's sum and its place in the block, since generated ids are consecutive there. ``df`` must be as read.
    """
    if "row_index" in df.select("_metadata").schema["_metadata"].dataType.names:
        return df, F.col("_metadata.row_index")
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    blocks = df.select(file.alias("__file"), block.alias("__block"), F.monotonically_increasing_id().alias("__id"))
    blocks = blocks.groupBy("__file", "__block").agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).drop("__first", "__rows")
    placed = df.select("*", "_metadata", F.monotonically_increasing_id().alias("__row"))
    same = (placed["_metadata.file_path"] == blocks["__file"]) & (placed["_metadata.file_block_start"] == blocks["__block"])
    return placed.join(blocks, same), F.col("__before") + F.col("__row")


def with_provenance(
    df: DataFrame,
    load_time: Column | None = None,
    snapshot_time: Column | None = None,
    version: str | None = None,
    component: str | None = None,
    source_checksum: Column | None = None,
) -> DataFrame:
    """Add the eight ``meta_*`` columns of a file source; the offset is the row's number in its file, from 0."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    numbered, offset = _row_numbers(df)
    loaded = load_time if load_time is not None else F.current_timestamp()
    hashed = record_hash(df, df.columns)
    values = {
        "meta_source_name": F.col("_metadata.file_name"),
        "meta_source_checksum": source_checksum if source_checksum is not None else F.lit(None).cast("string"),
        "meta_load_dt": loaded,
        "meta_snapshot_dt": snapshot_time if snapshot_time is not None else loaded,
        "meta_source_offset": offset,
        "meta_checksum": hashed,
        "meta_pipeline_version": F.lit(version).cast("string"),
        "meta_component": F.lit(component).cast("string"),
    }
    return numbered.select(*columns, *[values[name].alias(name) for name in META_COLUMNS])


def check_captures(pattern: str, captures: dict[int, str], columns: Sequence[str] | None = None) -> None:
    """A file name rule must compile, use existing groups and name declared columns."""
    try:
        groups = re.compile(pattern).groups
    except re.error as problem:
        raise ValueError(f"file name pattern does not compile: {problem}") from problem
    beyond = [g for g in captures if not 1 <= g <= groups]
    if beyond:
        raise ValueError(f"pattern has {groups} groups, not {beyond}")
    unknown = [c for c in captures.values() if columns is not None and c not in columns]
    if unknown:
        raise ValueError(f"captured columns are not declared: {unknown}")


def capture_from_name(
    df: DataFrame, pattern: str, captures: dict[int, str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Columns from groups of a pattern over the file name; no match gives NULL."""
    check_captures(pattern, captures, columns)
    name = F.col("_metadata.file_name")
    found = {
        column: F.when(name.rlike(pattern), F.regexp_extract(name, pattern, group))
        for group, column in captures.items()
    }
    return df.select("*", *[c.alias(column) for column, c in found.items()])
