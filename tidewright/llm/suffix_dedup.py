"""Removal of repeated passages: distributed suffix sorting with a difference cover, exact to the byte.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or another;
strings are judged on the input, never across texts.

1. Partition. Every string of ``length`` bytes has an anchor: the leftmost of its ``GRAM``-byte grams with the smallest
   hash. Equal strings have equal anchors, so strings are only ever compared under one anchor, and anchors that occur
   once need no comparison. A run of strings that share an anchor travels as one row of text.
2. Difference cover, in tasks that hold whole anchors. The character at a position is the name of its ``UNIT`` bytes, so
   positions fall into three classes modulo 3 * UNIT; classes 1 and 2 are the cover. Triples of characters at cover
   positions are sorted and named; triples of names are sorted in turn, which ranks cover positions by 9 * UNIT bytes.
   The remaining class is merged through ranks one or two characters further on: with class 1 by (character,
   rank), with class 2 by (character, character, rank), as any two positions have a cover position at a common distance.
3. Adjacent strings of equal rank whose last bytes agree too are repeats; runs of them become byte spans.

Anchors with over ``hot_rows`` runs would make one large group (a passage that very many texts share); the strings
under them are counted one by one by two 64-bit names instead, with partial sums, so no task gets such a group.
Equal texts are one text that counts as two and share its spans.

Defined results: a null text is empty; a text shorter than ``length`` loses nothing; repeated rows are copies of each
other; a null id is an id; an empty table gives an empty table; other columns are left out. Long texts are read in
overlapping segments. Names of characters are 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.session import scratch_path

LENGTH = 200
GRAM = 40
UNIT = 22
SEGMENT = 1 << 19
HOT_ROWS = 20_000
BATCH_BYTES = 1 << 20
#: rows of (text key, list) that may be broadcast after they have been counted
MOST_BROADCAST = 400_000
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
PLACE_BITS = np.uint64(20)
PLACE_MASK = np.uint64((1 << 20) - 1)
MULTIPLIERS = [np.uint64(m) for m in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Roller:
    """Hashes of all substrings of one size, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.r_[self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))]
            self.down = np.r_[self.down, self.down * np.uint64(pow(self.inverse, k, 1 << 64))]

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def grams(self, data: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
        sums = self.sums(data) if sums is None else sums
        return mixed((sums[size:] - sums[:-size]) * self.down[: len(sums) - size])


ROLLER = Roller()


def anchored_runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, anchor hash) of the runs of strings that share an anchor."""
    hashes = ROLLER.grams(data, gram)
    span = length - gram + 1
    m = len(hashes)
    packed = (hashes & ~PLACE_MASK) | np.arange(m, dtype=np.uint64)
    rows = np.full((-(-m // span), span), MASK, np.uint64)
    rows.ravel()[:m] = packed
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    lowest = np.minimum(after[: m - span + 1], before[span - 1 : m])
    place = (lowest & PLACE_MASK).astype(np.int64)
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return first, np.diff(np.r_[first, len(place)]), hashes[place[first]]


def segments(text: bytes, length: int = LENGTH, segment: int = SEGMENT) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, bytes) of overlapping pieces; each string of ``length`` starts in exactly one."""
    data = np.frombuffer(text, np.uint8)
    for at in range(0, max(0, len(data) - length + 1), segment):
        yield at, data[at : at + segment + length - 1]


def binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n_bytes, anchor, count) of every distinct anchor of a text."""
    for batch in batches:
        keys, sizes, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), binaries(batch.column(2))
        parts = []
        for row, text in enumerate(texts):
            found = [anchored_runs(piece)[2] for _, piece in segments(text or b"")]
            if found:
                values, counts = np.unique(np.concatenate(found), return_counts=True)
                parts.append((np.full(len(values), row), values, counts))
        if parts:
            rows, values, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[rows]), pa.array(sizes[rows]), pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))],
                names=["key", "n_bytes", "anchor", "n"],
            )


RUN_NAMES = ["anchor", "key", "n_bytes", "copies", "start", "n", "run"]
RUNS = "anchor long, key long, n_bytes long, copies long, start long, n int, run binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs of strings under listed anchors, with their bytes. Columns: key, n_bytes, copies, anchors, text."""
    for batch in batches:
        out: list[list] = [[] for _ in RUN_NAMES]

        def table() -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=RUN_NAMES)  # noqa: B023

        held = 0
        wanted = batch.column(3)
        for row, (key, size, copies, text) in enumerate(
            zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), binaries(batch.column(4)), strict=True)
        ):
            listed = np.sort(np.asarray(wanted[row].values, np.int64))
            for at, piece in segments(text or b""):
                first, n, anchor = anchored_runs(piece)
                anchor = anchor.view(np.int64)
                near = np.minimum(np.searchsorted(listed, anchor), len(listed) - 1)
                for i in np.flatnonzero(listed[near] == anchor).tolist():
                    a, b = int(first[i]), int(first[i] + n[i])
                    run = piece[a : b + LENGTH - 1].tobytes()
                    for column, value in zip(out, (int(anchor[i]), key, size, copies, at + a, b - a, run), strict=True):
                        column.append(value)
                    held += len(run)
            if held > BATCH_BYTES:
                yield table()
                for column in out:
                    column.clear()
                held = 0
        if out[0]:
            yield table()


def named(*parts: np.ndarray) -> np.ndarray:
    """Order-preserving where small enough, else hashed: one number per tuple of names."""
    if all(len(p) == 0 or int(p.max()) < 1 << 21 for p in parts) and len(parts) <= 3:
        out = np.zeros(len(parts[0]), np.uint64)
        for p in parts:
            out = (out << np.uint64(21)) | p.astype(np.uint64)
        return out
    total = np.zeros(len(parts[0]), np.uint64)
    for p, m in zip(parts, MULTIPLIERS, strict=False):
        total = mixed(total + p.astype(np.uint64) * m + m)
    return total


def ranks(keys: np.ndarray) -> np.ndarray:
    """Dense names of the keys in sorted order."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])[: len(keys)]
    return out


def adjacent_equal(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Whether each key's neighbours in sorted order, weights counted, make it occur twice or more."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    group = np.cumsum(np.r_[False, ranked[1:] != ranked[:-1]])[: len(keys)]
    out = np.empty(len(keys), bool)
    out[order] = np.bincount(group, weights[order])[group] > 1
    return out


def repeated_starts(data: np.ndarray, starts: np.ndarray, copies: np.ndarray, length: int = LENGTH, unit: int = UNIT) -> np.ndarray:
    """For strings of ``length`` bytes at ``starts`` of ``data``: whether another start holds the same string.

    ``copies`` counts how often each start stands for. All strings lie inside ``data``.
    """
    character = ROLLER.grams(data, unit)
    tail = ROLLER.grams(data, length - 9 * unit) if length > 9 * unit else np.zeros(len(data), np.uint64)
    kind = (np.arange(len(data)) // unit) % 3
    cover = np.flatnonzero(kind[: len(data) - 3 * unit + 1] > 0)
    triple = np.zeros(len(data), np.int64)
    triple[cover] = ranks(named(*(character[cover + k * unit] for k in range(3))))

    def rank_of(at: np.ndarray, units: int) -> np.ndarray:
        """Names of the next 7, 8 or 9 characters at cover positions: triples of triples, the last one short."""
        last = triple[at + 6 * unit] if units == 9 else None
        if units < 9:  # the short end is named by its own characters
            last = ranks(named(*(character[at + (6 + k) * unit] for k in range(units - 6))))
        return ranks(named(triple[at], triple[at + 3 * unit], last))

    of = kind[starts]
    out = np.zeros(len(starts), bool)
    end = tail[starts + 9 * unit] if length > 9 * unit else np.zeros(len(starts), np.uint64)

    def settle(chosen: np.ndarray, *parts: np.ndarray) -> None:
        keys = named(ranks(named(*parts)), ranks(end[chosen]))
        out[chosen] |= adjacent_equal(keys, copies[chosen])

    own = np.flatnonzero(of > 0)
    settle(own, rank_of(starts[own], 9))
    one = np.flatnonzero(of != 2)
    settle(one, ranks(character[starts[one]]), rank_of(starts[one] + unit, 8))
    two = np.flatnonzero(of != 1)
    at = starts[two]
    settle(two, ranks(character[at]), ranks(character[at + unit]), rank_of(at + 2 * unit, 7))
    return out


SPAN_NAMES = ["key", "n_bytes", "a", "b"]
SPANS = "key long, n_bytes long, a long, b long"


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte spans [a, b) of repeats, from runs sorted by anchor; whole anchors are compared at a time."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size < BATCH_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        anchor = table.column(0).to_numpy()
        cut = int(np.searchsorted(anchor, anchor[-1], side="left"))
        if cut:
            yield from _compare(table.slice(0, cut))
        held, size = [table.slice(cut)], sum(map(len, table.column(6).slice(cut).to_pylist()))
    if held:
        yield from _compare(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _compare(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Anchors in blocks of about BATCH_BYTES; one anchor is never split."""
    anchor = table.column(0).to_numpy()
    sizes = np.cumsum([len(r) for r in table.column(6).to_pylist()])
    at = 0
    while at < table.num_rows:
        before = int(sizes[at - 1]) if at else 0
        end = min(int(np.searchsorted(sizes, before + BATCH_BYTES)) + 1, table.num_rows)
        end = int(np.searchsorted(anchor, anchor[end - 1], side="right"))
        yield _spans(table.slice(at, end - at))
        at = end


def _spans(table: pa.RecordBatch) -> pa.RecordBatch:
    runs = table.column(6).to_pylist()
    data = np.frombuffer(b"".join(runs), np.uint8)
    lengths = np.array([len(r) for r in runs])
    n = table.column(5).to_numpy().astype(np.int64)
    first = np.cumsum(lengths) - lengths
    row = np.repeat(np.arange(len(runs)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    hit = np.zeros(0, bool)
    if len(row):
        hit = repeated_starts(data, first[row] + inner, table.column(3).to_numpy()[row].astype(np.float64))
    row, inner = row[hit], inner[hit]
    fresh = np.r_[True, (row[1:] != row[:-1]) | (inner[1:] != inner[:-1] + 1)][: len(row)]
    begin = np.flatnonzero(fresh)
    last = np.r_[begin[1:] - 1, len(row) - 1][: len(begin)]
    key, size, start = (table.column(c).to_numpy() for c in (1, 2, 4))
    owner = row[begin]
    return pa.RecordBatch.from_arrays(
        [pa.array(key[owner]), pa.array(size[owner]), pa.array(start[owner] + inner[begin]), pa.array(start[owner] + inner[last] + LENGTH)],
        names=SPAN_NAMES,
    )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per string of a run, with two names of its bytes; for hot anchors alone."""
    second = Roller(0xC2B2AE3D27D4EB4F)
    for batch in batches:
        for i, run in enumerate(batch.column(6).to_pylist()):
            data = np.frombuffer(run, np.uint8)
            names = [r.grams(data, LENGTH).view(np.int64) for r in (ROLLER, second)]
            n = len(names[0])
            fixed = [np.full(n, batch.column(c)[i].as_py()) for c in (1, 2, 3)]
            start = np.arange(n) + batch.column(4)[i].as_py()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*names, *fixed, start)], names=["w1", "w2", "key", "n_bytes", "copies", "a"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union of [a, b) spans; touching spans are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside ``spans``."""
    at, kept = 0, []
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return b"".join([*kept, text[at:]])


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hot_rows: int = HOT_ROWS) -> DataFrame:
    """doc_id, ``text`` and ``spans`` (array of a, b: byte spans that repeat, maximal and in order; null if none)."""
    spark = docs.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.parquet(path)

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= MOST_BROADCAST else df

    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(content).alias("key"), F.octet_length(content).cast("long").alias("n_bytes"),
                       F.col(text).cast("string").alias("text"))
    long_rows = rows.filter(F.col("n_bytes") >= LENGTH)
    anchors = stored(long_rows.select("key", "n_bytes", "text").mapInArrow(_anchors, "key long, n_bytes long, anchor long, n long"), "anchors")
    counts = anchors.groupBy("anchor").agg(F.sum("n").alias("total")).filter("total > 1")
    listed = anchors.select("key", "n_bytes", "anchor").join(counts, "anchor").groupBy("key", "n_bytes").agg(F.collect_set("anchor").alias("anchors"))
    chosen = long_rows.groupBy("key", "n_bytes").agg(F.min("doc_id").alias("held"), F.count(F.lit(1)).alias("copies"))
    listed = stored(listed.join(chosen, ["key", "n_bytes"]), "listed")
    texts = long_rows.join(
        small(listed.select(F.col("key").alias("k"), F.col("n_bytes").alias("b"), "anchors", "held", "copies")),
        (F.col("key") == F.col("k")) & (F.col("n_bytes") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("held")),
    )
    runs = texts.select("key", "n_bytes", "copies", "anchors", "text").mapInArrow(_runs, RUNS)
    hot = stored(counts.filter(F.col("total") > hot_rows).select("anchor"), "hot-anchors")
    has_hot = hot.limit(1).count() > 0
    if has_hot:
        runs = stored(runs, "runs")
    plain = runs.join(hot, "anchor", "left_anti") if has_hot else runs
    spans = plain.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_repeats, SPANS)
    if has_hot:
        windows = runs.join(hot, "anchor", "left_semi").select(*RUN_NAMES).mapInArrow(_windows, "w1 long, w2 long, key long, n_bytes long, copies long, a long")
        windows = stored(windows, "windows")
        twice = windows.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).filter("n > 1").select("w1", "w2")
        found = windows.join(twice, ["w1", "w2"]).select("key", "n_bytes", "a", (F.col("a") + LENGTH).alias("b"))
        spans = spans.unionByName(found)
    listed_spans = spans.groupBy("key", "n_bytes").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    listed_spans = stored(listed_spans.mapInArrow(_merged_spans, "key long, n_bytes long, spans array<struct<a: long, b: long>>"), "spans")
    found = small(listed_spans.select(F.col("key").alias("k"), F.col("n_bytes").alias("b"), "spans"))
    return rows.join(found, (F.col("key") == F.col("k")) & (F.col("n_bytes") == F.col("b")), "left").select("doc_id", "text", "spans")


def _merged_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"a": a, "b": b} for a, b in merged([(s["a"], s["b"]) for s in found])] for found in batch.column(2).to_pylist()]
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind)], names=["key", "n_bytes", "spans"])


def cut_digests(spanned: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what repeated_spans returns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(binaries(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                cuts = [(s["a"], s["b"]) for s in spans or []]
                kept = cut_out(text or b"", cuts)
                out.append((len(text or b""), len(text or b"") - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
            parts = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    kind = spanned.schema["doc_id"].dataType.simpleString()
    return spanned.select("doc_id", "text", "spans").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
