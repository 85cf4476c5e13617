"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.session import scratch_path

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def word_count(text: Column) -> Column:
    """Number of words of the whole text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def join_by_key(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], spread: Sequence[str], how: str = "left", salts: int = 32
) -> DataFrame:
    """Join ``rows`` to ``small`` (one row per key) on null-safe ``keys``.

    Each key of ``small`` is repeated ``salts`` times and ``rows`` are dealt over the salts by a hash
    of the columns ``spread``, so a key with a third of all rows is many tasks' work even where the
    side is too large for a broadcast. The salt is a function of the row, so retried tasks agree.
    Names of the helper columns are chosen apart from those of either side.
    """
    salt, dealt, *ends = unused([*rows.columns, *small.columns], "__salt", "__s", *[f"__k{i}" for i in range(len(keys))])
    left = rows.withColumn(salt, F.pmod(F.xxhash64(*[F.col(c) for c in spread]), F.lit(salts)).cast("int"))
    right = small.withColumn(dealt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = right.select(*[F.col(k).alias(end) for k, end in zip(keys, ends, strict=True)], dealt,
                         *[c for c in small.columns if c not in keys])
    on = F.col(salt) == F.col(dealt)
    for k, end in zip(keys, ends, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(end))
    return left.join(right, on, how).drop(salt, dealt, *ends)


def unused(columns: Sequence[str], *labels: str) -> list[str]:
    """The labels, with underscores in front of those that are names of ``columns``, in any spelling of case."""
    taken = {c.lower() for c in columns}
    found = []
    for label in labels:
        while label.lower() in taken:
            label = f"_{label}"
        taken.add(label.lower())
        found.append(label)
    return found


class Scratch:
    """Intermediate tables of one run in the shared folder; they go as soon as nothing needs them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[tuple[str, str]] = []

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        """The table, written and read again: its lineage ends in the shared folder."""
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.append((label, path))
        return self.spark.read.parquet(path)

    def discard(self, *labels: str) -> None:
        """Delete the run's tables of these labels; only what later stored tables already contain."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for label, path in [x for x in self.paths if x[0] in labels]:
            folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)
            self.paths.remove((label, path))
