"""Ranked search against plain scoring of every document, ties and hard rows included."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewright.llm import lexical_search, queries

SF = "/root/testdata/sf0.001"
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def terms(text):
    return TERMS.findall((text or "").translate(str.maketrans(UPPER, UPPER.lower())))


def plain(docs, items, k=10):
    """docs of (id, text), items of (id, text): rows by scoring all documents for all items."""
    bags = [(doc, Counter(terms(text))) for doc, text in docs]
    n, total = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    found = []
    for item, text in {*items}:
        scores = []
        for doc, bag in bags:
            m = 100 - 75 + (75 * bag.total() * n) // total if total else 0
            score = sum(
                q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m))
                for t, q in Counter(terms(text)).items() if bag[t])
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        found += [(item, i + 1, doc, -s) for i, (s, _, _, doc) in enumerate(sorted(scores)[:k])]
    return sorted(found, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def pairs(df, name):
    return [tuple(r) for r in df.select(name, "text").collect()]


def test_query_over_the_whole_table(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    assert found(queries.op12_lexical_search(spark, SF)) == plain(pairs(docs, "doc_id"), pairs(items, "item_id"))


@pytest.mark.parametrize("limits", [{"shard_docs": 3}, {"shard_postings": 50, "block_mb": 0.002}, {"k": 1}, {"k": 400}])
def test_shards_and_blocks_do_not_change_the_ranking(spark, limits):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.filter("length(text) < 3000").repartition(5)
    expected = plain(pairs(docs, "doc_id"), pairs(items, "item_id"), limits.get("k", 10))
    assert found(lexical_search.rank_documents(docs, items, **limits)) == expected


def test_hard_rows_and_ties(spark):
    same = "alpha beta gamma"
    texts = [(i, same) for i in range(40, 0, -1)] + [(7, same), (None, same), (None, None), (90, ""), (91, " -- \n"), (92, "ALPHA!alpha,Élan\x00beta"),
                                                      (93, "z " * 200_000 + "delta"), (94, "élan 日本語 x1y2"), (95, "KK ſ")]
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in texts], "doc_id long, text string, score string, rank int, item_id int").repartition(6)
    asked = [(1, "Alpha beta alpha"), (1, "Alpha beta alpha"), (2, None), (3, ""), (4, "nowhere"), (5, "élan Élan delta K"), (None, "gamma"), (6, "日本語; k")]
    items = spark.createDataFrame([(i, t, 0, "clash") for i, t in asked], "item_id long, text string, doc_id int, rank string")
    assert found(lexical_search.rank_documents(docs, items, shard_docs=4)) == plain(texts, [a for a in asked if a[1]])
    for d, q in ((docs.filter("false"), items), (docs, items.filter("false")), (docs.select("doc_id", F.lit("").alias("text")), items)):
        out = lexical_search.rank_documents(d, q)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]


def lists_of(postings, n_docs):
    rows = sorted((t, d, tf) for (t, d), tf in postings.items())
    term, place, tf = (np.array(c, np.int32) for c in zip(*rows, strict=True))
    return lexical_search.ImpactLists(list(range(n_docs)), [50] * n_docs, term, place, tf, np.array([3, 5, 2]), n_docs, 50 * n_docs)


def test_reading_stops_at_the_best_positions():
    """A few documents stand at the top of every list: most of the long tails are never looked at."""
    rng = np.random.default_rng(1)
    postings = {(t, d): int(rng.integers(1, 4)) for t in range(3) for d in range(5000)} | {(t, d): 40 + d for t in range(3) for d in range(12)}
    lists = lists_of(postings, 5000)
    top = sorted(lists.best(np.arange(3), np.ones(3, np.int64), 10, np.empty(0, np.int64)), reverse=True)[:10]
    scores = defaultdict(int)
    for p, v in zip(lists.keys % 5000, lists.impact, strict=True):
        scores[int(p)] += int(v)
    assert top == sorted(((s, d) for d, s in scores.items()), reverse=True)[:10]
    assert lists.looked_up < 200
    before = lists.looked_up
    assert list(lists.best(np.arange(3), np.ones(3, np.int64), 10, np.full(10, 10**9))) == [] and lists.looked_up - before <= 48
