"""Run and baseline history: appended parquet, partitioned by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_runs(runs: DataFrame, path: str) -> None:
    """Add run rows; ``run_timestamp`` decides the ``run_date`` partition."""
    dated = runs.withColumn("run_date", F.col("run_timestamp").cast("date"))
    dated.write.mode("append").partitionBy("run_date").parquet(path)


def read_runs(
    spark: SparkSession,
    path: str,
    table: str | None = None,
    pipeline: str | None = None,
    from_date: str | None = None,
) -> DataFrame:
    """History of a table, newest first; the date bound prunes partitions."""
    rows = spark.read.parquet(path)
    if from_date is not None:
        rows = rows.filter(F.col("run_date") >= F.lit(from_date).cast("date"))
    if table is not None:
        rows = rows.filter(F.col("table_name") == table)
    if pipeline is not None:
        rows = rows.filter(F.col("pipeline") == pipeline)
    return rows.orderBy(F.col("run_timestamp").desc())


def latest_run(runs: DataFrame, keys: tuple[str, ...] = ("pipeline", "table_name")) -> DataFrame:
    """The newest run row per key, as an aggregate instead of a sort."""
    rest = [c for c in runs.columns if c not in keys]
    # the whole row is the tiebreak, so equal timestamps still pick one row
    order = F.struct("run_timestamp", F.xxhash64(*runs.columns))
    picked = runs.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return picked.select(*keys, "r.*")


def last_validated(runs: DataFrame, table: str, pipeline: str) -> dt.datetime | None:
    """When the table was last validated in this pipeline, NULL before its first run."""
    mine = runs.filter((F.col("table_name") == table) & (F.col("pipeline") == pipeline))
    return mine.agg(F.max("run_timestamp").alias("m")).first()["m"]
