"""Quality rules: basic rules of a single text, then line frequency across the documents of a host.

Basic rules (``base_failed``): fewer than ``min_words`` words, or over ``most_repeated`` percent of the
words inside 5-word windows that the text holds twice or more.

Across documents: lines are normalised (words in lower case, A-Z only, joined by one space) and hashed;
the distinct documents (distinct whole texts) of a host that hold a line are counted. Lines held by
over ``line_share`` of the host's distinct texts, and by ``min_docs`` or more, are removed; a document that
keeps less than ``least_left`` percent of its words is depleted and rejected. Counting distinct texts
instead of rows keeps a group of exact copies, which is deduplication's work, from condemning its own lines.

Defined results: a null or empty text has no words and fails the basic rules; a null host is a host of its
own; repeated rows are judged one by one; an empty table gives an empty table; other columns pass through,
those named like the results are replaced.

One pass of Python over Arrow batches reads the texts, several at a time and never a host; the counting
is Spark's, over 64-bit line hashes with partial sums, so hot hosts and hot lines are spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, join_by_key, unused
from tidewright.session import scratch_path

MIN_WORDS = 10
MOST_REPEATED = 20
WINDOW = 5
LINE_SHARE = 0.1
MIN_DOCS = 10
LEAST_LEFT = 30
NOT_SYMBOLS = bytes(b for b in range(256) if b not in b"#*$%&|<>")
CONTINUATION = bytes(range(0x80, 0xC0))
FACTS = (
    "__host string, __digest long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "__lines array<long>, __line_words array<int>"
)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more, each word once."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    codes, room = ids[:n].copy(), len(known)
    for k in range(1, size):
        if room > 2**62 // len(known):  # exact pair codes: renumber before they could overflow
            codes = np.unique(codes, return_inverse=True)[1]
            room = n
        codes = codes * len(known) + ids[k : k + n]
        room *= len(known)
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int32)
    edges[:n] += twice
    edges[size : size + n] -= twice
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def text_facts(text: bytes) -> tuple[int, int, int, int, int, list[int], list[int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, line hashes, words per line."""
    words = text.split()
    chars = len(b"".join(words).translate(None, CONTINUATION))
    symbols = len(text.translate(None, NOT_SYMBOLS))
    seen: set[bytes] = set()
    dup, hashes, counts = 0, [], []
    for line in text.split(b"\n"):
        parts = line.split()
        if parts:
            dup += line in seen
            seen.add(line)
            hashes.append(xxhash.xxh3_64_intdigest(b" ".join(parts).lower()) - 2**63)
            counts.append(len(parts))
    return len(words), chars, symbols, dup, repeated_words(words), hashes, counts


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, host and digest as they came, then the facts of the last column, the text."""
    for batch in batches:
        rows = [text_facts(t or b"") for t in batch.column(3).cast(pa.binary()).to_pylist()]
        parts = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], *[pa.array(p, pa.int64()) for p in parts[:5]],
             pa.array(parts[5], pa.list_(pa.int64())), pa.array(parts[6], pa.list_(pa.int32()))],
            names=["doc_id", "__host", "__digest", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "__lines", "__line_words"],
        )


def document_facts(docs: DataFrame, doc_id: str, host: str, text: str) -> DataFrame:
    """The basic counts and lines of every row; written to the shared folder, since two jobs read them."""
    spark = docs.sparkSession
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("__host"),
                        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("__digest"), F.col(text).alias("__text"))
    path = scratch_path(spark, "quality-facts")
    named.mapInArrow(_facts, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, {FACTS}").write.parquet(path)
    return spark.read.parquet(path)


def judge_documents(
    docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", min_words: int = MIN_WORDS,
    most_repeated: int = MOST_REPEATED, line_share: float = LINE_SHARE, min_docs: int = MIN_DOCS, least_left: int = LEAST_LEFT,
) -> DataFrame:
    """One row per row: doc_id, ``host``, ``text_hash``, the basic counts, ``n_removed_words``, ``base_failed``, ``kept``."""
    facts = document_facts(docs, doc_id, host, text)
    texts = facts.groupBy("__host", "__digest").agg(F.first("__lines").alias("__lines"))
    totals = texts.groupBy("__host").agg(F.count(F.lit(1)).alias("__total"))
    counts = (
        texts.select("__host", F.explode(F.array_distinct("__lines")).alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count(F.lit(1)).alias("__docs"))
        .filter(F.col("__docs") >= min_docs)
    )
    above = (
        join_by_key(counts, totals, ["__host"], ["__line"], "inner")
        .filter(F.col("__docs") > line_share * F.col("__total"))
        .groupBy("__host")
        .agg(F.collect_list("__line").alias("__above"))
    )
    removed = F.aggregate(
        F.zip_with("__lines", "__line_words", lambda h, n: F.when(F.array_contains("__above", h), n).otherwise(0)),
        F.lit(0).cast("long"), lambda a, b: a + b,
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    return (
        join_by_key(facts, above, ["__host"], ["__digest", "doc_id"])
        .withColumn("n_removed_words", F.when(F.col("__above").isNull(), F.lit(0).cast("long")).otherwise(removed))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (100 * left >= least_left * F.col("n_words")))
        .select("doc_id", F.col("__host").alias("host"), F.col("__digest").alias("text_hash"), "n_words", "word_chars",
                "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "base_failed", "kept")
    )


def keep_judged(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that the rules keep; the verdict is a function of host and text."""
    rejected = judge_documents(docs, doc_id, host, text, **limits).filter(~F.col("kept"))
    at, whole = unused(docs.columns, "__host", "__digest")
    rejected = rejected.select(F.col("host").alias(at), F.col("text_hash").alias(whole)).distinct()
    digest = F.xxhash64(F.coalesce(docs[text], F.lit("")))
    return docs.join(rejected, docs[host].cast("string").eqNullSafe(F.col(at)) & (digest == F.col(whole)), "left_anti")


QUERY_SQL = rf"""
with words as (
  select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
grams as (
  select doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') as gram
  from (select doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as i from words)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, gram) as c from grams) where c > 1),
repeated as (
  select doc_id, count(distinct i + k) as n from (select doc_id, i, unnest(range(0, {WINDOW})) as k from twice) group by doc_id),
pieces as (
  select doc_id, source, line, place, regexp_extract_all(line, '{WORD}') as ws from (
    select doc_id, source, unnest(string_split(text, chr(10))) as line,
           generate_subscripts(string_split(text, chr(10)), 1) as place from words)),
dups as (
  select doc_id, sum((nth > 1)::int)::bigint as n from (
    select doc_id, row_number() over (partition by doc_id, line order by place) as nth from pieces where len(ws) > 0) group by doc_id),
keyed as (
  select doc_id, source, len(ws) as n, translate(array_to_string(ws, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from pieces where len(ws) > 0),
totals as (select source, count(distinct text) as total from words group by source),
counts as (
  select k.source, k.key, count(distinct w.text) as docs from keyed k join words w on k.doc_id = w.doc_id group by k.source, k.key),
above as (
  select c.source, c.key from counts c join totals t on c.source is not distinct from t.source
  where c.docs >= {MIN_DOCS} and c.docs > {LINE_SHARE} * t.total),
removed as (
  select k.doc_id, sum(k.n)::bigint as n from keyed k join above a on k.source is not distinct from a.source and k.key = a.key group by k.doc_id),
facts as (
  select w.doc_id, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(d.n, 0)::bigint as n_dup_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words, coalesce(x.n, 0)::bigint as n_removed_words
  from words w left join dups d on w.doc_id = d.doc_id left join repeated r on w.doc_id = r.doc_id left join removed x on w.doc_id = x.doc_id),
based as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words as base_failed from facts)
select *, not base_failed and 100 * (n_words - n_removed_words) >= {LEAST_LEFT} * n_words as kept from based"""
