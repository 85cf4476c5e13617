"""Write modes: append, snapshot, and small single-file exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.plans.ingest import snapshot_latest


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Keyless increments: rows are added, repeated rows accumulate."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_snapshot(df: DataFrame, path: str, latest_only: str | None = None) -> None:
    """Replace the whole table; with ``latest_only`` by the newest delivery's rows."""
    rows = snapshot_latest(df, latest_only) if latest_only else df
    rows.write.mode("overwrite").parquet(path)


def sorted_by_all(df: DataFrame) -> DataFrame:
    """A total order over all columns, for exports that are compared as text."""
    return df.orderBy(*[F.col(f"`{c}`").asc_nulls_first() for c in df.columns])


def _ordered_lines(df: DataFrame, delimiter: str, header: bool, row_count_footer: bool) -> DataFrame:
    """Delimited lines with their place: header 0, rows 1 in their given order, footer 2."""
    spark = df.sparkSession
    row = F.to_csv(
        F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"sep": delimiter, "emptyValue": ""}
    )
    out = df.select(
        F.lit(1).alias("_part"), F.monotonically_increasing_id().alias("_seq"), row.alias("value")
    )
    zero = F.lit(0).cast("bigint")
    if header:
        names = F.lit(delimiter.join(df.columns))
        out = spark.range(0, 1, 1, 1).select(F.lit(0), zero, names).unionAll(out).toDF(*out.columns)
    if row_count_footer:
        out = out.unionAll(df.agg(F.count(F.lit(1)).cast("string").alias("v")).select(F.lit(2), zero, "v"))
    return out


def as_lines(
    df: DataFrame, delimiter: str = "|", header: bool = True, row_count_footer: bool = False
) -> DataFrame:
    """The rows as delimited text lines, the header before and the row count after them.

    The header and the footer are partitions of their own, the rows keep their partitioning, so
    the part files of a partitioned write are in order.
    """
    return _ordered_lines(df, delimiter, header, row_count_footer).select("value")


def wants_footer(table: str) -> bool:
    """Disposition tables are delivered with a trailing row count."""
    return "disposition" in table.lower()


def write_lines(lines: DataFrame, path: str) -> None:
    """Partitioned text: part files in order, none of them holding the whole export."""
    lines.write.mode("overwrite").text(path)


def write_single_file(
    df: DataFrame,
    path: str,
    delimiter: str = "|",
    row_count_footer: bool = False,
) -> None:
    """One delimited file at exactly ``path``, of any size.

    The lines are made in parallel; behind a shuffle one last task sorts (with spilling) and writes
    them, which a single file needs. It is written beside the target and then renamed. Tables
    that need no single file are written faster by ``write_lines``.
    """
    spark = df.sparkSession
    staging = f"{path}.parts"
    # merging partitions does not keep their order, so the lines carry their place
    lines = _ordered_lines(df, delimiter, True, row_count_footer).repartition(1)
    ordered = lines.sortWithinPartitions("_part", "_seq").select("value")
    ordered.write.mode("overwrite").text(staging)
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(staging)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(
        s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")
    )
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not move the export to {path}")
    fs.delete(folder, True)
