"""Ranked lexical search by the Best Position Algorithm over impact lists, in shards of documents.

A term's impact in a document depends on counts over all documents, so there are two passes for a block of items:

1. Index. Each task cuts its documents into terms and writes shards: for every term that an item of the block asks for,
   the documents that hold it with their counts. Shards are bounded in postings and documents, so a term held by every
   document is many short lists. The sums over shards give N, L and the terms' document counts.
2. Search. In a shard every term's list is ordered by falling impact. For an item all its lists are read in step, some
   positions at a time; a document met for the first time is looked up in all other lists at once (direct access), which
   gives its score and its positions there. A list's best position is the last of the unbroken run of seen positions from
   its top, whichever access saw them. No document still unseen can score more than the sum of the impacts at the best
   positions; once that is strictly below the k-th score so far, the shard is done. Strictly, so that documents of equal
   score are all seen and the smaller id wins. The k-th score is carried on through a task's shards.

Then k rows per item and task are ranked, first within lanes, then over all. Items go to the tasks in blocks of
``block_mb`` of text (a block of their hash; one item at least), each block with an index of its own.

Defined results: terms are the maximal runs of characters other than ASCII ones that are no letters or digits, A-Z in
lower case; a null text has none; documents of score 0 do not rank; equal scores rank by ascending id, null last; of equal
rows each ranks, items equal in id and text are one; empty tables give an empty table; other columns do not pass.
The index is written to the shared folder before it is searched.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from tidewright.llm.common import Scratch

SHARD_POSTINGS = 2**18
SHARD_DOCS = 2**14
BLOCK_MB = 4
STEP = 16
LANES = 16
#: other ASCII bytes than letters and digits part terms; capitals become small letters
FOLDED = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(128)) + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLDED).split()


def _index(vocabulary: dict[bytes, int], most_postings: int, most_docs: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (id, text) to shards: counts, ids and lengths of documents, and postings ordered by term and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ids, lengths = [0, 0], [], []
        terms: list[np.ndarray] = []
        tfs: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            size = [len(t) for t in terms]
            term = np.concatenate([np.empty(0, np.int32), *terms])
            place = np.repeat(np.arange(len(ids), dtype=np.int32), size)
            order = np.lexsort((place, term))
            held, holding = np.unique(term, return_counts=True)
            row = (*counts, held, holding, ids, lengths, term[order], place[order], np.concatenate([np.empty(0, np.int32), *tfs])[order])
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        postings = 0
        for batch in batches:
            texts = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                words = terms_of(texts[i].as_py() or b"")
                if not words:
                    continue
                counts[0] += 1
                counts[1] += len(words)
                held = Counter([v for v in map(vocabulary.get, words) if v is not None])
                if not held:
                    continue
                ids.append(doc)
                lengths.append(len(words))
                terms.append(np.fromiter(held.keys(), np.int32, len(held)))
                tfs.append(np.fromiter(held.values(), np.int32, len(held)))
                postings += len(held)
                if postings >= most_postings or len(ids) >= most_docs:
                    yield shard()
                    counts, ids, lengths, postings = [0, 0], [], [], 0
                    terms.clear()
                    tfs.clear()
        yield shard()

    return run


class ImpactLists:
    """The lists of one shard: postings by (term, document) for direct access, and by falling impact for sorted access."""

    def __init__(self, ids: list, lengths: list[int], term: np.ndarray, place: np.ndarray, tf: np.ndarray, weights: np.ndarray, n: int, total: int):
        self.ids = ids
        norm = np.array([25 + 75 * x * n // total for x in lengths], np.int64)
        tf = tf.astype(np.int64)
        self.impact = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * norm[place]))
        self.keys = term.astype(np.int64) * len(ids) + place
        by_impact = np.lexsort((place, -self.impact, term))
        self.sorted_place, self.sorted_impact = place[by_impact], self.impact[by_impact]
        self.begin = np.searchsorted(term, np.arange(len(weights) + 1))
        #: position of every posting in its term's list
        self.position = np.empty(len(term), np.int64)
        self.position[by_impact] = np.arange(len(term)) - self.begin[term]
        #: documents looked up for all items so far
        self.looked_up = 0

    def best(self, terms: np.ndarray, repeats: np.ndarray, k: int, floor: np.ndarray) -> Iterator[tuple[int, int]]:
        """(score, document's place) of all that can be among the k best, given the best scores found elsewhere."""
        begin, length = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        held = length > 0
        terms, repeats, begin, length = terms[held], repeats[held], begin[held], length[held]
        if not len(terms):
            return
        longest = int(length.max())
        # the column behind a list's end stays unseen, so that a run always ends; shorter lists are padded by it
        seen = np.zeros((len(terms), longest + 1), bool)
        met = np.zeros(len(self.ids), bool)
        scores, places = [], []
        lists = np.arange(len(terms))[:, None]
        depth, step = 0, STEP
        while depth < longest:
            at = np.arange(depth, min(depth + step, longest))
            inside = at[None, :] < length[:, None]
            new = np.unique(self.sorted_place[(begin[:, None] + at[None, :])[inside]])
            new = new[~met[new]]
            depth, step = depth + step, 2 * step
            if len(new):
                met[new] = True
                self.looked_up += len(new)
                wanted = terms[:, None].astype(np.int64) * len(self.ids) + new[None, :]
                found = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
                hit = self.keys[found] == wanted
                scores.append((np.where(hit, self.impact[found], 0) * repeats[:, None]).sum(axis=0))
                places.append(new)
                seen[np.broadcast_to(lists, hit.shape)[hit], self.position[found[hit]]] = True
                floor = np.sort(np.concatenate([floor, scores[-1]]))[-k:]
            run = seen.argmin(axis=1)
            last = self.sorted_impact[begin + np.maximum(run, 1) - 1]
            bound = int((np.where(run < length, last, 0) * repeats).sum())
            if len(floor) == k and floor[0] > bound:
                break
        least = max(int(floor[0]), 1) if len(floor) == k else 1
        for score, place in zip(scores, places, strict=True):
            good = score >= least
            yield from zip(score[good].tolist(), place[good].tolist(), strict=True)


def _search(
    items: list[tuple[object, list[int], list[int]]], weights: list[int], n: int, total: int, k: int, schema: pa.Schema
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Shards to the k best documents of a task for every item (number, terms, repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = [(np.array(t, np.int64), np.array(r, np.int64)) for _, t, r in items]
        best: list[list[tuple]] = [[] for _ in items]
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths = (batch.column(c)[row].as_py() for c in (0, 1))
                term, place, tf = (batch.column(c)[row].values.to_numpy() for c in (2, 3, 4))
                if not len(term):
                    continue
                lists = ImpactLists(ids, lengths, term, place, tf, np.array(weights, np.int64), n, total)
                for i, (terms, repeats) in enumerate(asked):
                    floor = np.array(sorted(-b[0] for b in best[i]), np.int64)
                    found = ((-score, ids[p] is None, ids[p]) for score, p in lists.best(terms, repeats, k, floor))
                    best[i] = heapq.nsmallest(k, [*best[i], *found], key=lambda b: b[:2] if b[1] else b)
        rows = [(items[i][0], doc, -score) for i, held in enumerate(best) for score, _, doc in held]
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def rank_documents(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    k: int = 10, block_mb: float = BLOCK_MB, shard_postings: int = SHARD_POSTINGS, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's k highest-scoring documents."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    named = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    asked = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    asked = scratch.stored(asked.withColumn("spot", F.xxhash64("item_id", "text")), "search-items")
    id_type, item_type = (to_arrow_type(d.schema[c].dataType) for d, c in ((named, "doc_id"), (asked, "item_id")))
    shards_like = pa.schema([("n_docs", pa.int64()), ("n_terms", pa.int64()), ("held", pa.list_(pa.int32())),
                             ("holding", pa.list_(pa.int64())), ("ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())),
                             ("term", pa.list_(pa.int32())), ("place", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
    found_like = pa.schema([("spot", pa.int64()), ("doc_id", id_type), ("score", pa.int64())])

    weight = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, math.ceil(weight / (block_mb * 2**20)))
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod("spot", F.lit(blocks)) == block).select("spot", F.col("text").cast("binary")).collect()
        vocabulary: dict[bytes, int] = {}
        block_items = []
        for spot, body in rows:
            held = Counter(vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(body))
            block_items.append((spot, list(held.keys()), list(held.values())))
        made = named.mapInArrow(_index(vocabulary, shard_postings, shard_docs, shards_like), from_arrow_schema(shards_like))
        shards = scratch.stored(made, f"search-shards-{block}")
        n, total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not n or not vocabulary:
            continue
        holding = shards.select(F.explode(F.arrays_zip("held", "holding")).alias("t")).groupBy("t.held").agg(F.sum("t.holding"))
        holding = dict(holding.collect())
        weights = [math.floor(1000 * math.log((2 * n + 2) / (2 * holding.get(t, 0) + 1))) for t in range(len(vocabulary))]
        best = shards.select("ids", "lengths", "term", "place", "tf").mapInArrow(
            _search(block_items, weights, n, total, k, found_like), from_arrow_schema(found_like))
        best = scratch.stored(best, "search-best")
        scratch.discard(f"search-shards-{block}")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], from_arrow_schema(found_like))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    lane = F.pmod(F.xxhash64("doc_id"), F.lit(LANES))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("spot", lane).orderBy(*order))).filter(F.col("place") <= k)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("spot").orderBy(*order))).filter(F.col("rank") <= k)
    return found.join(asked, "spot").select("item_id", "rank", "doc_id", "score")


_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+'))"
#: DuckDB twin of the query
QUERY_SQL = f"""
with tf as (select doc_id, term, count(*) as tf from (select doc_id, {_TERMS} as term from documents) group by all),
lens as (select doc_id, sum(tf)::bigint as n from tf group by all),
totals as (select count(*)::bigint as n_all, sum(n)::bigint as l_all from lens),
df as (select term, count(*)::bigint as df from tf group by all),
asked as (select item_id, term, count(*) as times from (select item_id, {_TERMS} as term from benchmark) group by all),
scored as (
  select item_id, doc_id,
         sum(times * floor(1000 * ln((2 * n_all + 2)::double / (2 * df + 1)::double))::bigint
             * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_all) // l_all)))))::bigint as score
  from asked join df using (term) join tf using (term) join lens using (doc_id) cross join totals group by all)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0
qualify rank <= 10"""
