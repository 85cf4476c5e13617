"""From raw documents to sampled pieces: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Null texts fail the quality rules; tables without rows stay without rows; repeated rows are one
document after the third stage; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.llm import line_dedup, ngram_join, piece_sampling, quality_rules, source_mixing
from tidewright.llm.common import unused
from tidewright.session import scratch_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.keep_judged(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source go, counted over its distinct texts; ``n_chars`` follows the text."""
    kept = line_dedup.drop_boilerplate_lines(docs, distinct_texts=True)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents stays, the one with the smallest id."""
    return ngram_join.keep_one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix takes them, so that each source comes to its target in words."""
    digest = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    key, name, whole, origin, times, copy = unused(docs.columns, "__key", "__id", "__digest", "__source", "__times", "__copy")
    keyed = docs.withColumn(key, F.struct("doc_id", digest.alias("digest")))
    mixed = source_mixing.take_documents(keyed, doc_id=key).filter("times > 0")
    mixed = mixed.groupBy("doc_id", "source").agg(F.max("times").alias(times))
    mixed = mixed.select(F.col("doc_id.doc_id").alias(name), F.col("doc_id.digest").alias(whole), F.col("source").alias(origin), times)
    same = docs["doc_id"].eqNullSafe(F.col(name)) & docs["source"].eqNullSafe(F.col(origin)) & (digest == F.col(whole))
    taken = docs.join(mixed, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return taken.select(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled piece ids of every text; ``lossless`` says that they decode to it."""
    return piece_sampling.sample_pieces(docs, verify="lossless")


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("source_mixing", mixture),
    ("piece_sampling", pieces),
]

#: sampled segmentation has no SQL form; the tests hold the pipeline against a plain rendering of it
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
