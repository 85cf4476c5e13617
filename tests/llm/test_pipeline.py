"""The pipeline against a plain rendering of its stages on a small corpus."""

import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewright.llm import line_dedup, ngram_join, quality_rules, source_mixing
from tidewright.session import cut_lineage
from tests.llm.test_operators import plain_classes, plain_targets

SF = "/root/testdata/sf0.001"


def plain_times(rows):
    """Copies of each document in the mix, for sources of one shard: quotas of blocks by highest quotients; then, on
    the seeded line of a source, whole passes, and once more the documents whose middle lies in the words still due."""
    block = source_mixing.BLOCK_WORDS
    lines = defaultdict(list)
    for doc, source, text, digest in rows:
        name = hashlib.md5(f"{source_mixing.SEED}:{{{doc}, {digest}}}".encode()).hexdigest()
        lines[source].append((name, doc, len((text or "").split())))
    words = {s: sum(n for _, _, n in line) for s, line in lines.items()}
    targets = plain_targets(words)
    quota = Counter()
    for _ in range(round(sum(targets.values()) / block)):
        quota[max(sorted(targets), key=lambda s: targets[s] / (2 * quota[s] + 1))] += 1
    times = Counter()
    for source, line in lines.items():
        due = min(quota[source] * block, 2 * words[source])
        passes, rest = divmod(due, words[source])
        start = 0
        for _, doc, n in sorted(line):
            times[doc] += (passes + (start + n / 2 <= rest)) if n else 0
            start += n
    return +times


def test_stages_take_effect_and_pieces_decode(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = corpus_pipeline.run(spark, SF)
    assert found.columns == [*docs.columns, "piece_ids", "lossless"]
    rows = found.collect()
    assert rows and all(r["lossless"] for r in rows)

    kept = {r["doc_id"] for r in quality_rules.judge_documents(docs).collect() if r["kept"]}
    lined = line_dedup.drop_boilerplate_lines(docs.filter(docs.doc_id.isin(*kept)), distinct_texts=True)
    texts = {r["doc_id"]: r["text"] for r in lined.collect()}
    classes = plain_classes(sorted(texts.items()))
    firsts = {c for _, _, c in classes}
    remaining = lined.filter(lined.doc_id.isin(*firsts)).select("doc_id", "source", "text", F.xxhash64("text").alias("digest"))
    assert Counter(r["doc_id"] for r in rows) == plain_times([tuple(r) for r in remaining.collect()])
    assert all(r["text"] == texts[r["doc_id"]] and r["n_chars"] == len(r["text"]) for r in rows)


def test_stages_stand_empty_tables_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
        assert stage(spark, hard, SF).count() <= 3, name


def test_near_duplicates_keep_the_named_document(spark):
    docs = spark.createDataFrame([(5, "a b c d e f g"), (3, "A B c d e f g"), (9, "x y")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in ngram_join.keep_one_of_each(docs).collect()) == [3, 9]


@pytest.mark.parametrize("weights", [None, (1, 3, 9)])
def test_mixture_brings_each_source_to_its_target(spark, monkeypatch, weights):
    if weights:
        plain = source_mixing.take_documents
        monkeypatch.setattr(source_mixing, "take_documents", lambda *a, **k: plain(*a, **k, weights=weights))
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    before, longest, after = Counter(), Counter(), Counter()
    texts = {}
    for r in docs.collect():
        size = len((r["text"] or "").split())
        before[r["source"]] += size
        longest[r["source"]] = max(longest[r["source"]], size)
        texts[r["doc_id"]] = r["text"]
    rows = corpus_pipeline.mixture(spark, docs, SF).collect()
    for r in rows:
        after[r["source"]] += len(r["text"].split())
    assert all(r["text"] == texts[r["doc_id"]] for r in rows)
    targets = plain_targets(before, weights or (5, 2, 1))
    assert {round(t / before[s], 1) for s, t in targets.items()} - {0.0, 1.0, 2.0}
    for s, target in targets.items():
        assert abs(after[s] - target) <= longest[s] / 2 + 2 * source_mixing.BLOCK_WORDS, s


def test_one_exact_copy_comes_through_with_its_text(spark):
    """Copies that are a third of a source's rows; a line on every page still goes."""
    words = "river stone window lamp garden paper cloud bridge market coat".split()
    own = lambda i: " ".join(f"{w}{i * 31 + k}" for k, w in enumerate(words * 2))
    copied = f"{own(1000)}\n{own(1001)}"
    rows = [(i, copied, "en", "s", len(copied)) for i in range(20)]
    rows += [(100 + i, f"the same line on all the other pages\n{own(i)}", "en", "s", 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = cut_lineage(stage(spark, docs, SF))
    found = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert found == {0: copied, **{100 + i: own(i) for i in range(40)}}
