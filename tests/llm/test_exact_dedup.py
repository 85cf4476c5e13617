"""Exact deduplication: hard rows, full tables and hot contents against a plain grouping."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewright.llm import exact_dedup, queries

SF = "/root/testdata/sf0.001"


def plain(rows):
    groups = defaultdict(list)
    for doc, text in rows:
        groups[text or ""].append(doc)
    found = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        left = True
        for doc in sorted(ids, key=lambda i: (i != keep, i is None, i or 0)):
            found.append((doc, keep, len(ids), left, hashlib.sha256(text.encode()).hexdigest()))
            left = False
    return sorted(found, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def hard(spark):
    texts = [(1, None), (2, ""), (3, "one"), (3, "one"), (4, "One"), (None, "one"), (None, "alone"), (None, "alone"), (5, "x" * 3_000_000),
             (6, "x" * 3_000_000), (7, "x" * 2_999_999 + "y"), (8, "é\x00 日本"), (9, "é\x00 日本"), (10, "one "), (11, "\n")]
    rows = [(i, t, "s", "clash", "clash", i == 3, "clash") for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, kept_id string, Place string, entry string, kept boolean, `_place` string").repartition(3)


def test_hard_rows(hard):
    rows = [tuple(r) for r in hard.select("doc_id", "text").collect()]
    assert found(exact_dedup.find_copies(hard)) == plain(rows)
    none = exact_dedup.find_copies(hard.filter("false"))
    assert none.count() == 0 and none.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    left = exact_dedup.drop_copies(hard)
    assert left.columns == hard.columns
    assert sorted(r["text"] or "" for r in left.collect()) == sorted({t or "" for _, t in rows})
    assert exact_dedup.drop_copies(hard.filter("false")).count() == 0


def test_normalising_decides_what_is_equal(spark):
    docs = spark.createDataFrame([("b", "One"), ("a", "one"), ("c", None), (None, "ONE")], "name string, body string")
    rows = found(exact_dedup.find_copies(docs, "name", "body", normalised=F.lower))
    assert [r[:4] for r in rows] == [("a", "b", 3, False), ("b", "b", 3, True), ("c", "c", 1, True), (None, "b", 3, False)]
    assert rows[0][4] == hashlib.sha256(b"one").hexdigest()


@pytest.mark.parametrize("limits", [{}, {"table_mb": 0.01}, {"table_mb": 0.004, "held_rows": 40, "lane_mb": 0.001, "lanes": 2}])
def test_every_limit_gives_the_same_rows(spark, limits):
    """Tables that fill up send records through many rounds; tiny lanes make most contents hot."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 900).alias("text"))
    hot = spark.range(5000, 5600, 1, 30).select(F.col("id").alias("doc_id"), F.lit("the same text everywhere " * 9).alias("text"))
    docs = docs.unionByName(hot).repartition(12)
    rows = [tuple(r) for r in docs.collect()]
    assert found(exact_dedup.find_copies(docs, **limits)) == plain(rows)


def test_equal_fingerprints_do_not_make_equal_texts():
    table = exact_dedup.ContentTable(2**20)
    numbers = [table.find(i % 3, str(i).encode()) for i in range(3000)]
    assert numbers == list(range(3000)) and [table.find(i % 3, str(i).encode()) for i in range(3000)] == numbers


def test_a_full_table_takes_no_new_contents():
    table = exact_dedup.ContentTable(1000)
    assert table.find(1, b"a" * 5000) == 0, "one content always fits"
    assert table.find(2, b"b") == -1 and table.find(1, b"a" * 5000) == 0 and table.find(2, b"b") == -1


def test_query_over_the_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_exact_dedup(spark, SF)) == plain(rows)
