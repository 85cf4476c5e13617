"""Exact deduplication by Grace hashing: partition to files until every bucket's contents fit an open-addressing table.

1. Local tables. Each task reads its documents through a table of bounded size: a row whose whole content is in the
   table joins that entry, else it founds one. A full table is emptied (its entries go on) and a new one begun, so a
   task holds ``table_mb`` of contents at most, or one longer text. Every row is written with its entry; the content goes
   only with the entry's best row. Copies in one split never leave it.
2. Rounds. Entries are dealt into buckets by a hash of their fingerprint and the round's number, as many as their bytes
   need. A bucket's task streams its records into one table: records of equal content meet there. Once a content does not
   fit, the table takes no new ones: records of resident contents still settle, all others are written out, and only
   these are partitioned again, by another hash, in the next round. Every bucket settles a table's worth a round, so the
   rounds end.
3. Hot contents. Where the records of one fingerprint weigh over ``lane_mb`` (copies in very many splits), they are first
   dealt over lanes; a lane's task keeps one record for all of its own, and these go on to the next round. At most
   bytes / lane_mb fingerprints can be hot, which bounds the list of them.

Fingerprints only deal and address; two records are equal when their whole contents are, whatever the fingerprints.

Defined results: a null text counts as empty; of equal texts the row with the largest ``doc_id`` stays (a null id is below
all others; of equal ids one row); every row is reported, repeated ones too; an empty table gives an empty table; the
columns not named do not pass through ``find_copies``, and all columns do through ``drop_copies``.

Rows with their entries are written to the shared folder before anything is derived from them, and so is each round, so
a lost executor repeats tasks and never mixes two numberings of entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from tidewright.llm.common import Scratch, unused

TABLE_MB = 48
LANE_MB = 256
LANES = 64
#: rows a task holds before it writes them with their entries
HELD_ROWS = 65_536
#: contents in one outgoing batch of Arrow
OUT_BYTES = 2**25


class ContentTable:
    """Open addressing with linear probing over (fingerprint, whole content); slots hold entry numbers."""

    def __init__(self, budget: int):
        self.budget, self.used, self.closed = budget, 0, False
        self.slots = [-1] * 1024
        self.prints: list[int] = []
        self.contents: list[bytes] = []

    def _slot(self, fingerprint: int, content: bytes) -> int:
        """The slot of this content, or the empty one where it would go."""
        mask = len(self.slots) - 1
        at = fingerprint & mask
        while (entry := self.slots[at]) >= 0:
            if self.prints[entry] == fingerprint and self.contents[entry] == content:
                return at
            at = (at + 1) & mask
        return at

    def find(self, fingerprint: int, content: bytes) -> int:
        """The entry of this content, new if it fits; -1 if it does not, and from then on for every new content."""
        at = self._slot(fingerprint, content)
        if self.slots[at] >= 0:
            return self.slots[at]
        if self.closed or (self.contents and self.used + len(content) > self.budget):
            self.closed = True
            return -1
        entry = self.slots[at] = len(self.contents)
        self.prints.append(fingerprint)
        self.contents.append(content)
        self.used += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, fingerprint in enumerate(self.prints):
            at = fingerprint & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def above(one, other) -> bool:
    """Order of document ids: a null is below all others."""
    return one is not None and (other is None or one > other)


def _batches(rows: Iterator[tuple], schema: pa.Schema, sized: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; column ``sized`` holds the contents."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row[sized] or b"")
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _local(budget: int, held_rows: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, content to one row per document with its entry; the entry's best row carries the content and its totals."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        made = TaskContext.get().partitionId() << 40
        table, ids, entries = ContentTable(budget), [], []

        def written() -> Iterator[tuple]:
            count, best = [0] * len(table.contents), [-1] * len(table.contents)
            for row, entry in enumerate(entries):
                count[entry] += 1
                if best[entry] < 0 or above(ids[row], ids[best[entry]]):
                    best[entry] = row
            digests = [hashlib.sha256(c).hexdigest() for c in table.contents]
            for row, entry in enumerate(entries):
                content = table.contents[entry] if best[entry] == row else None
                yield (ids[row], made + entry, content is not None, digests[entry], table.prints[entry] - 2**63,
                       len(table.contents[entry]), count[entry], content)

        for batch in batches:
            contents = batch.column(1)
            for i, doc in enumerate(batch.column(0).to_pylist()):
                content = contents[i].as_py() or b""
                fingerprint = xxhash.xxh3_64_intdigest(content)
                entry = table.find(fingerprint, content) if len(entries) < held_rows else -1
                if entry < 0:
                    yield from written()
                    made += len(table.contents)
                    table, ids, entries = ContentTable(budget), [], []
                    entry = table.find(fingerprint, content)
                ids.append(doc)
                entries.append(entry)
        yield from written()

    return lambda batches: _batches(rows(batches), schema, 7)


def _bucket(budget: int, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Records of whole buckets to what became of each: ``into`` is the record that stands for its content.

    A record that is refused, or stands for a lane, goes on to the next round and carries its content and totals; the
    fate of all records with ``open`` is that of their ``into`` there.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        table = ContentTable(budget)
        members: list[list[int]] = []
        stands: list[tuple] = []
        for batch in batches:
            contents = batch.column(0)
            for i, (entry, top, fingerprint, n, lane) in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)):
                content = contents[i].as_py()
                at = table.find(fingerprint + 2**63, content)
                if at < 0:
                    yield entry, entry, top, n, True, fingerprint, len(content), content
                elif at == len(members):
                    members.append([entry])
                    stands.append((top, entry, n, lane is not None))
                else:
                    members[at].append(entry)
                    old, kept, total, laned = stands[at]
                    if above(top, old) or (top == old and entry < kept):
                        old, kept = top, entry
                    stands[at] = (old, kept, total + n, laned)
        for i, (top, kept, n, laned) in enumerate(stands):
            content = table.contents[i]
            for entry in members[i]:
                on = laned and entry == kept
                yield entry, kept, top, n, laned, table.prints[i] - 2**63, len(content), content if on else None

    return lambda batches: _batches(rows(batches), schema, 7)


def find_copies(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", normalised: Callable[[Column], Column] = lambda c: c,
    table_mb: float = TABLE_MB, lane_mb: float = LANE_MB, lanes: int = LANES, held_rows: int = HELD_ROWS,
) -> DataFrame:
    """One row per row: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text in UTF-8)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    budget = int(table_mb * 2**20)
    named = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).cast("string").cast("binary").alias("content"))
    id_type = to_arrow_type(named.schema["doc_id"].dataType)
    fate = [("print", pa.int64()), ("n_bytes", pa.int64())]
    local = pa.schema([("doc_id", id_type), ("entry", pa.int64()), ("best", pa.bool_()), ("text_sha256", pa.string()), *fate,
                       ("n_rows", pa.int64()), ("content", pa.binary())])
    settled = pa.schema([("entry", pa.int64()), ("into", pa.int64()), ("top", id_type), ("n_rows", pa.int64()), ("open", pa.bool_()), *fate,
                         ("content", pa.binary())])
    rows = scratch.stored(named.mapInArrow(_local(budget, held_rows, local), from_arrow_schema(local)), "copies-rows")

    todo = rows.filter("best").withColumnRenamed("doc_id", "top")
    rounds: list[DataFrame] = []
    while True:
        weight = F.sum(F.col("n_bytes") + 200)
        total = todo.agg(weight).first()[0] or 0
        # heavy fingerprints with more records than two rounds of lanes would keep; their number is bounded by the limit
        limit = max(int(lane_mb * 2**20), total // 1_000_000)
        hot = todo.groupBy("print").agg(weight.alias("weight"), F.count(F.lit(1)).alias("records"))
        hot = hot.filter((F.col("weight") > limit) & (F.col("records") > 2 * lanes)).select("print")
        hot = scratch.stored(hot, "copies-hot")
        dealt = todo.withColumn("lane", F.lit(None).cast("int"))
        if not hot.isEmpty():
            lane = F.when(F.col("hot"), F.pmod(F.xxhash64("entry"), F.lit(lanes)).cast("int"))
            dealt = todo.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "print", "left").withColumn("lane", lane)
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // budget))
        dealt = dealt.repartition(buckets, F.xxhash64(F.lit(len(rounds)), F.col("print"), F.col("lane")))
        dealt = dealt.select("content", "entry", "top", "print", "n_rows", "lane")
        rounds.append(scratch.stored(dealt.mapInArrow(_bucket(budget, settled), from_arrow_schema(settled)), f"copies-round-{len(rounds)}"))
        todo = rounds[-1].filter(F.col("content").isNotNull())
        if todo.isEmpty():
            break

    fates = rounds[-1].select("entry", "into", "top", "n_rows")
    for earlier in reversed(rounds[:-1]):
        later = fates.toDF("into", "__into", "top", "n_rows")
        done = earlier.filter("not open").select("entry", "into", "top", "n_rows")
        fates = done.unionByName(
            earlier.filter("open").select("entry", "into").join(later, "into").select("entry", F.col("__into").alias("into"), "top", "n_rows")
        )
    return (
        rows.select("doc_id", "entry", "best", "text_sha256")
        .join(fates, "entry")
        .select("doc_id", F.col("top").alias("keep_id"), F.col("n_rows").alias("group_size"),
                (F.col("best") & (F.col("entry") == F.col("into"))).alias("kept"), "text_sha256")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """The rows of ``docs`` that stay, all columns; of rows with equal id and text, one (the first by their other columns)."""
    kept_id, digest, place = unused(docs.columns, "kept_id", "kept_digest", "place")
    normal = limits.get("normalised", lambda c: c)(F.col(text)).cast("string")
    kept = find_copies(docs, doc_id, text, **limits).filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(digest))
    found = docs.join(kept, F.col(doc_id).eqNullSafe(F.col(kept_id)) & (F.sha2(F.coalesce(normal, F.lit("")), 256) == F.col(digest)))
    others = [F.col(c) for c, kind in docs.dtypes if c not in (doc_id, text) and not kind.startswith(("map", "variant"))]
    one = Window.partitionBy(kept_id, digest).orderBy(*others, F.lit(0))
    return found.withColumn(place, F.row_number().over(one)).filter(F.col(place) == 1).select(*[F.col(c) for c in docs.columns])


#: DuckDB twin of the query
QUERY_SQL = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept, sha256(coalesce(text, '')) as text_sha256
from documents window same as (partition by coalesce(text, ''))"""
