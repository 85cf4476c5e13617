"""Files that arrive over time, as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidewright.functions.casts import cast_table
from tidewright.sources.files import Delimited
from tidewright.specs import TableDef


def read_landing(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str,
    fmt: str = "parquet",
    how: Delimited | None = None,
    files_per_batch: int | None = None,
) -> DataFrame:
    """New files of one format as a stream, with their file name and load time.

    Delimited files land as strings; the schema is stated, never inferred.
    """
    reader = spark.readStream.schema(schema)
    if fmt == "csv":
        reader = reader.options(**(how or Delimited()).options())
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    landed = reader.format(fmt).load(path)
    return landed.select(
        "*",
        F.col("_metadata.file_path").alias("_source_file"),
        F.current_timestamp().alias("_load_ts"),
    )


def typed_stream(stream: DataFrame, spec: TableDef, keep: tuple[str, ...] = ()) -> DataFrame:
    """The batch cast projection on a stream: stateless, row by row."""
    return cast_table(stream, spec, keep)


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = ()
) -> StreamingQuery:
    """Keyless appends to Parquet; the checkpoint makes each file count once."""
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return writer.start()


def deduplicated(stream: DataFrame, keys: list[str], time: str, within: str) -> DataFrame:
    """First row per key, remembered only as long as the watermark allows."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(keys)
