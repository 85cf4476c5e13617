"""N-gram Jaccard self-join with multiple-global-order filtering, and the classes it links.

A document's set holds its distinct 5-word shingles (words in lower case, A-Z only); with fewer words the whole sequence
is its one shingle. Two sets link when their Jaccard similarity is ``percent`` / 100 or more. If two sets link, their
prefixes (the first n - ceil(t * n) + 1 shingles) share a shingle under *every* global order of the shingles. So:

1. One pass hashes shingles, names each distinct set and counts shingles in a sketch of fixed size.
2. Orders: shingles whose sketch count stands out come last, by magnitude; the rest follow a hash, another one per
   order. Common passages so leave the prefixes. Any order is valid: the sketch decides speed, never results.
3. Prefixes under the first order are posted, with set size and place in the order. Each posting list proposes its
   lowest and highest set as partners of all others (a star, not all pairs) where sizes and places still allow the
   similarity. Candidates must also share prefix shingles under the second and third order; what passes is verified on
   whole sets. Links join sets to components.
4. Lists whose members are in one component are done. The other short ones get more stars, each round around members of
   another choice, as long as pairs across components (counted, not kept) far outnumber the sets and rounds still link.
   In the short lists that are then still open, pairs across components go through the same filters.
5. Long lists that are still open (families of near copies with members just too far from all others) never make all
   their pairs. The set with the fewest rare shingles is the pivot p of its lists, and each member a is compared with it:
   gone(a) = p - a, extra(a) = a - p, D(a) = both. As |a & b| = |p| - |gone(a)| - |gone(b)| + |D(a) & D(b)|, members in
   different components link only if their differences share as many shingles as the sizes lack. So differences meet by
   prefixes once more: |D| less the least number lacking towards any member of another component, plus 1. Nothing is
   capped, so every component is exact.

Lists of a shingle that the sketch shows as very common are dealt over salts, so no task gets a whole one; the others
are bounded by their sketch count. Equal sets are one name, so groups of copies cost one member each. Defined results: a null text or one without words has
an empty set, links with nothing and is its own class; repeated rows are linked through their common set; ties
cannot matter, as classes are named by their smallest doc_id; null ids never name a class unless all are null; an
empty table gives an empty table; other columns are left out.

Hashes of shingles have 64 bits. Intermediate tables are in the shared folder. Tasks turn texts, lists and blocks of the
sketch into rows in parts of about ``PART_BYTES``, however large Spark's batches are: neither a worker nor its executor's
JVM holds what a whole batch becomes (a posting list of a text is larger than the text).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, unused
from tidewright.llm.components import connected

WORDS_PER_SHINGLE = 5
PERCENT = 75
SKETCH_BITS = 22
SKETCH_BLOCK = 1 << 14
#: blocks of a sketch that a task hands over at once
BLOCKS_AT_ONCE = 16
#: bytes of texts, or of lists of hashes, that a task turns into rows at once
PART_BYTES = 1 << 20
#: shingles of this class or above are posted over SALTS salts
HOT_CLASS = 3
SALTS = 64
#: members of a list that is compared through its pivot
LONG_LIST = 200
#: shingles of pivots that may be broadcast; more are joined by a shuffle
MOST_PIVOT_SHINGLES = 1_000_000
#: orders of members among which the second round of stars chooses by list
STAR_ORDERS = 4
#: stars go on while lists hold more pairs across components than this for each set that was compared so far
PAIRS_PER_SET = 4
#: (id, hash) rows that may be broadcast to pick texts; more are joined by a shuffle
MOST_BROADCAST = 200_000
ORDERS = (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273)
POWERS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes | None, size: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], np.uint64)
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += each[k : k + n] * POWERS[k % len(POWERS)]
        total = (total << np.uint64(7)) | (total >> np.uint64(57))
    return np.unique(mixed(total))


def cells(tokens: np.ndarray) -> np.ndarray:
    return ((tokens * POWERS[1]) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def prefix_size(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, classes: np.ndarray, order: int, percent: int = PERCENT) -> np.ndarray:
    """The first tokens under one global order, in that order: class first, then the order's hash."""
    rank = (classes[cells(tokens)].astype(np.uint64) << np.uint64(56)) | (mixed(tokens ^ np.uint64(order)) >> np.uint64(8))
    return tokens[np.argsort(rank)[: prefix_size(len(tokens), percent)]]


def binaries(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def parts_of(batches: Iterator[pa.RecordBatch], *columns: int) -> Iterator[pa.RecordBatch]:
    """The batches in runs of rows with about PART_BYTES of texts, or of lists of hashes, in these columns."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in map(batch.column, columns):
            length, unit = (pc.list_value_length, 8) if pa.types.is_list(column.type) else (pc.binary_length, 1)
            sizes += unit * pc.fill_null(length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + PART_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def packed(counts: np.ndarray) -> bytes:
    """Counts of a block in the smallest unsigned type that holds them all."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def unpacked(counts: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(counts, f"u{len(memoryview(counts)) // SKETCH_BLOCK}")


def packed_blocks(blocks: dict[int, np.ndarray]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Numbers and packed counts of the blocks, BLOCKS_AT_ONCE at a time."""
    numbers = list(blocks)
    for at in range(0, len(numbers), BLOCKS_AT_ONCE):
        some = numbers[at : at + BLOCKS_AT_ONCE]
        yield pa.array(some, pa.int32()), pa.array([packed(blocks[b]) for b in some], pa.binary())


def _name_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents (id, digest, set, size), then the task's sketch in blocks."""
    names = ["doc_id", "digest", "set_id", "n", "block", "counts"]
    sketch, id_type = np.zeros(1 << SKETCH_BITS, np.uint32), None
    for batch in parts_of(batches, 2):
        ids, sizes, id_type = [], [], batch.schema.field(0).type
        for text in binaries(batch.column(2)):
            tokens = shingles(text)
            sizes.append(len(tokens))
            ids.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63 if len(tokens) else None)
            np.add.at(sketch, cells(tokens), 1)
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
            names=names,
        )
    if id_type is not None:
        full = {b: counts for b, counts in enumerate(sketch.reshape(-1, SKETCH_BLOCK)) if counts.any()}
        for block, counts in packed_blocks(full):
            n = len(block)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_type), *[pa.nulls(n, pa.int64())] * 3, block, counts], names=names)


def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            part = unpacked(counts.as_buffer())
            if block in held:
                held[block] += part
            else:
                held[block] = part.astype(np.uint64)
    for block, counts in packed_blocks(held):
        yield pa.RecordBatch.from_arrays([block, counts], names=["block", "counts"])


def frequency_classes(blocks: DataFrame) -> np.ndarray:
    """Per cell of the sketch 0, or 1 + log2 of how far its count stands out. The sketch is of a fixed size."""
    summed = blocks.mapInArrow(_sum_blocks, "block int, counts binary")  # first within each task, then by block
    summed = summed.repartition("block").mapInArrow(_sum_blocks, "block int, counts binary")
    sketch = np.zeros(1 << SKETCH_BITS, np.uint64)
    for r in summed.collect():
        sketch[r["block"] * SKETCH_BLOCK : (r["block"] + 1) * SKETCH_BLOCK] += unpacked(r["counts"])
    usual = float(np.median(sketch))
    excess = (sketch.astype(np.float64) - usual) / (3 * np.sqrt(usual) + 3)
    return np.where(excess < 1, 0, 1 + np.floor(np.log2(np.maximum(excess, 1)))).astype(np.uint8)


POSTING = ("token", "salt", "set_id", "n", "place", "common")
POSTING_TYPES = "token long, salt int, set_id long, n int, place int, common int"


def _post(classes, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 0):
            parts: list[tuple[np.ndarray, ...]] = []
            for text in binaries(batch.column(0)):
                own = shingles(text)
                if len(own):
                    first = prefix(own, classes.value, ORDERS[0], percent)
                    name = xxhash.xxh3_64_intdigest(own.tobytes()) - 2**63
                    salt = np.where(classes.value[cells(first)] >= HOT_CLASS, name % SALTS + 1, 0)
                    common = np.count_nonzero(classes.value[cells(own)])
                    parts.append((first, salt, *[np.full(len(first), x) for x in (name, len(own))], np.arange(len(first)), np.full(len(first), common)))
            if parts:
                token, salt, name, n, place, common = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(token)), pa.array(salt.astype(np.int32)), pa.array(name.astype(np.int64)),
                     *[pa.array(x.astype(np.int32)) for x in (n, place, common)]], names=list(POSTING),
                )

    return run


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by (token, salt, set): distinct ones, without tokens that one set holds (hot ones all stay)."""
    held = None
    for batch in batches:
        table = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token = table.column(0).to_numpy()
        # the last token may go on in the next batch
        cut = int(np.searchsorted(token, token[-1], side="left"))
        if cut:
            yield _distinct_shared(table.slice(0, cut))
        held = table.slice(cut)
    if held is not None and held.num_rows:
        yield _distinct_shared(held)


def _distinct_shared(table: pa.RecordBatch) -> pa.RecordBatch:
    token, salt, name = (table.column(c).to_numpy() for c in range(3))
    fresh_token = np.r_[True, (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])]
    fresh = fresh_token | np.r_[True, name[1:] != name[:-1]]
    group = np.cumsum(fresh_token) - 1
    sets = np.bincount(group[fresh], minlength=group[-1] + 1)
    return table.filter(pa.array(fresh & ((sets[group] > 1) | (salt > 0))))


SETS = "set_id long, n long, tokens array<long>, prefix2 array<int>, prefix3 array<int>"


def _sets(classes, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(parts: list[np.ndarray], dtype) -> pa.Array:
            offsets = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype), *parts])))

        for batch in parts_of(batches, 1):
            sets = [shingles(text) for text in binaries(batch.column(1))]
            seconds = [[prefix(s, classes.value, o, percent).astype(np.uint32).view(np.int32) for s in sets] for o in ORDERS[1:]]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), lists([signed(s) for s in sets], np.int64),
                 *[lists(s, np.int32) for s in seconds]],
                names=["set_id", "n", "tokens", "prefix2", "prefix3"],
            )

    return run


DIFFERENCES = "pivot long, pivot_n long, pivot_label long, set_id long, n long, label long, gone int, differing array<long>"


def _differences(classes):
    """Ordered differences of a set from its pivot: what it has besides, rare shingles first, then what it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, 6, 7):
            columns = []
            for side in ("extra", "gone"):
                lists = batch.column(batch.schema.get_field_index(side))
                tokens = lists.flatten().to_numpy().view(np.uint64)
                kind = classes.value[cells(tokens)] if side == "extra" else np.full(len(tokens), 255, np.uint8)
                columns.append((np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()), kind, tokens))
            row, kind, tokens = (np.concatenate(x) for x in zip(*columns, strict=True))
            offsets = np.r_[0, np.cumsum(np.bincount(row, minlength=batch.num_rows))].astype(np.int32)
            tokens = tokens[np.lexsort((mixed(tokens ^ np.uint64(ORDERS[0])), kind, row))]
            gone = batch.column(batch.schema.get_field_index("gone")).value_lengths()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], gone, pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(tokens)))],
                names=["pivot", "pivot_n", "pivot_label", "set_id", "n", "label", "gone", "differing"],
            )

    return run


def _possible(a, b, percent: int):
    """Sizes allow the similarity, and so do the places of a shared token: what stands before the first is not common."""
    rest = F.least(a["n"] - a["place"], b["n"] - b["place"]).cast("long")
    both = a["n"].cast("long") + b["n"]
    return (100 * F.least(a["n"], b["n"]).cast("long") >= percent * F.greatest(a["n"], b["n"])) & ((100 + percent) * rest >= percent * both)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, stored) -> DataFrame:
    """The links among candidate pairs (a, b): the other orders first, then whole sets."""

    def both_sides(pairs: DataFrame, *columns: str) -> DataFrame:
        """The pairs with columns of either set; the pairs go to the sets where their number allows it."""
        near = F.broadcast(pairs) if pairs.count() <= MOST_BROADCAST else pairs
        sides = [
            sets.select("set_id", *columns).join(near, F.col("set_id") == F.col(end)).select("a", "b", *[F.col(c).alias(f"{end}_{c}") for c in columns])
            for end in ("a", "b")
        ]
        return sides[0].join(sides[1], ["a", "b"])

    shared = F.arrays_overlap("a_prefix2", "b_prefix2") & F.arrays_overlap("a_prefix3", "b_prefix3")
    passed = stored(both_sides(pairs, "prefix2", "prefix3").filter(shared).select("a", "b"), "passed")
    common = F.size(F.array_intersect("a_tokens", "b_tokens"))
    return (
        both_sides(passed, "n", "tokens")
        .withColumn("common", common)
        .filter(100 * F.col("common") >= percent * (F.col("a_n") + F.col("b_n") - F.col("common")))
        .select("a", "b")
    )


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, ``text_hash``, n_shingles, component_id (the smallest linked doc_id) and class_key (null: empty set) of every row."""
    spark = docs.sparkSession

    scratch = Scratch(spark)
    stored = scratch.stored

    chosen = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
                         F.col(text).cast("string").alias("text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    named = stored(chosen.mapInArrow(_name_sets, f"doc_id {kind}, digest long, set_id long, n long, block int, counts binary"), "named-sets")
    classes = spark.sparkContext.broadcast(frequency_classes(named.filter("block is not null").select("block", "counts")))
    members = named.filter("block is null").select("doc_id", "digest", "set_id", "n")
    posted = chosen.select("text").mapInArrow(_post(classes, percent), POSTING_TYPES)
    posted = posted.repartition("token", "salt").sortWithinPartitions("token", "salt", "set_id")
    shared = stored(posted.mapInArrow(_shared_only, POSTING_TYPES), "postings").drop("salt")

    posting_columns = ("set_id", "n", "place")
    posting = F.struct(*posting_columns)

    made: list[DataFrame] = []

    def sets_of(pairs: DataFrame) -> DataFrame:
        """Whole sets of the paired names and of earlier ones, made from the text of one document each, once."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
        for earlier in made:
            wanted = wanted.join(earlier.select("set_id"), "set_id", "left_anti")
        holders = members.join(wanted, "set_id").groupBy("set_id").agg(F.min(F.struct("doc_id", "digest")).alias("held"))
        holders = stored(holders.select("set_id", F.col("held.doc_id").alias("__id"), F.col("held.digest").alias("__digest")), "holders")
        if holders.count() <= MOST_BROADCAST:
            holders = F.broadcast(holders)
        texts = chosen.join(holders, chosen["doc_id"].eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")))
        # rows that repeat an id and its text make the same set again: one row each
        sets = texts.select("set_id", "text").mapInArrow(_sets(classes, percent), SETS)
        sets = stored(sets, "sets")
        repeats = sets.groupBy("set_id").count().filter("count > 1").limit(1).count() > 0
        made.append(stored(sets.dropDuplicates(["set_id"]), "sets") if repeats else sets)
        return reduce(DataFrame.unionByName, made)

    def star_pairs(postings: DataFrame, place) -> DataFrame:
        """Every member of a list with its first and its last one in the order of ``place``."""
        member = F.struct(place.alias("order"), *[F.col(c) for c in posting_columns])
        ends = postings.groupBy("token").agg(F.min(member).alias("low"), F.max(member).alias("high"))
        pairs = postings.join(ends, "token").select(posting.alias("x"), F.explode(F.array("low", "high")).alias("y"))
        pairs = pairs.filter(F.col("x.set_id") != F.col("y.set_id")).filter(_possible(F.col("x"), F.col("y"), percent))
        return pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()

    def open_lists(postings: DataFrame, roots: DataFrame) -> DataFrame:
        """The postings, with labels, of lists whose members are in several components."""
        own = ("token", *posting_columns, "common")
        labelled = postings.select(*own).join(roots, F.col("set_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "set_id"))
        tokens = labelled.groupBy("token").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count(F.lit(1)).alias("members"))
        return labelled.join(tokens.filter("l < h").select("token", "members"), "token").select(*own, "label", "members")

    def links_of(pairs: DataFrame) -> DataFrame:
        links = stored(_verified(pairs, sets_of(pairs), percent, stored), "links")
        scratch.discard("holders", "passed")
        return links

    def across(postings: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) of members of one list that are in different components, where sizes and places allow a link."""
        pairs = postings.select("token", F.col("label").alias("l"), posting.alias("x")).join(
            postings.select("token", F.col("label").alias("h"), posting.alias("y")), "token"
        )
        pairs = pairs.filter("l < h").filter(_possible(F.col("x"), F.col("y"), percent))
        return pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()

    def through_pivots(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of long lists: the links (a, b) of members with their pivots, and the other pairs across components that may link."""
        member = F.struct((F.col("n") - F.col("common")).alias("rare"), "set_id", "n", "label")
        pivots = postings.groupBy("token").agg(F.min(member).alias("p"))
        pivots = pivots.select("token", F.col("p.set_id").alias("pivot"), F.col("p.n").cast("long").alias("pivot_n"), F.col("p.label").alias("pivot_label"))
        groups = postings.join(pivots, "token").select("pivot", "pivot_n", "pivot_label", "set_id", F.col("n").cast("long").alias("n"), "label")
        groups = stored(groups.distinct(), "groups")
        sets = sets_of(groups.select(F.col("pivot").alias("a"), F.col("set_id").alias("b")))
        scratch.discard("holders")
        centres = groups.select("pivot", "pivot_n").distinct()
        few = (centres.agg(F.sum("pivot_n")).first()[0] or 0) <= MOST_PIVOT_SHINGLES
        near = F.broadcast if few else lambda side: side
        centres = sets.join(near(centres.select("pivot")), F.col("set_id") == F.col("pivot")).select("pivot", F.col("tokens").alias("theirs"))
        compared = groups.join(sets.select("set_id", "tokens"), "set_id").join(near(centres), "pivot")
        compared = compared.select("pivot", "pivot_n", "pivot_label", "set_id", "n", "label", F.array_except("tokens", "theirs").alias("extra"),
                                   F.array_except("theirs", "tokens").alias("gone"))
        found = stored(compared.mapInArrow(_differences(classes), DIFFERENCES), "differences")
        whole = 100 + percent
        bound = whole * (F.col("pivot_n") - F.col("gone")) >= percent * (F.col("pivot_n") + F.col("n"))
        # who links with the pivot is in its component, whatever was known before
        found = found.withColumn("label", F.when(bound, F.col("pivot_label")).otherwise(F.col("label")))
        found = found.withColumn("cost", percent * F.col("n") + whole * F.col("gone"))
        links = found.filter(bound).filter("pivot != set_id").select(F.least("pivot", "set_id").alias("a"), F.greatest("pivot", "set_id").alias("b"))
        # a pair lacks (cost + cost) / whole - pivot_n shared differences; the pivot has the least cost of all
        others = found.filter("label != pivot_label").groupBy("pivot").agg(F.min("cost").alias("other"))
        cheapest = F.when(F.col("label") == F.col("pivot_label"), F.col("other")).otherwise(percent * F.col("pivot_n"))
        lacking = F.ceil((F.col("cost") + cheapest - whole * F.col("pivot_n")) / whole)
        posted = found.join(near(others), "pivot").withColumn("size", F.size("differing"))
        length = F.greatest(F.least(F.col("size") - lacking + 1, F.col("size")), F.lit(0)).cast("int")
        posted = posted.withColumn("first", F.slice("differing", F.lit(1), length))
        posted = posted.select("pivot", "pivot_n", "set_id", "label", "cost", "size", F.posexplode("first").alias("at", "token"))
        posted = stored(posted.select("pivot", "token", "pivot_n", "set_id", "label", "cost", (F.col("size") - F.col("at")).alias("left")), "differences")
        x, y = (posted.select("pivot", "token", F.struct("pivot_n", "set_id", "label", "cost", "left").alias(end)) for end in ("x", "y"))
        enough = whole * (F.least("x.left", "y.left") + F.col("x.pivot_n")) >= F.col("x.cost") + F.col("y.cost")
        pairs = x.join(y, ["pivot", "token"]).filter(F.col("x.label") < F.col("y.label")).filter(enough)
        return links, pairs.select(F.least("x.set_id", "y.set_id").alias("a"), F.greatest("x.set_id", "y.set_id").alias("b")).distinct()

    # one star per list around the same few sets, then, where components of short lists remain apart, around a few others
    stars = stored(star_pairs(shared, F.col("set_id")), "stars")
    links = links_of(stars)
    rest = stored(open_lists(shared, stored(connected(links, "a", "b"), "roots")), "open")
    short, linked = rest.filter(F.col("members") <= LONG_LIST), True
    while linked and across(short).count() > PAIRS_PER_SET * sum(m.count() for m in made):
        order = F.xxhash64(F.pmod("token", F.lit(STAR_ORDERS)), F.lit(len(made)), "set_id")
        others = stored(star_pairs(short, order).join(stars, ["a", "b"], "left_anti"), "stars")
        found = links_of(others)
        linked = not found.isEmpty()
        links, stars = links.unionByName(found), stars.unionByName(others)
        rest = stored(open_lists(rest, stored(connected(links, "a", "b"), "roots")), "open")
        short = rest.filter(F.col("members") <= LONG_LIST)
    candidates, long = across(short), rest.filter(F.col("members") > LONG_LIST)
    if not long.isEmpty():
        to_pivots, distant = through_pivots(long)
        links, candidates = links.unionByName(to_pivots), candidates.unionByName(distant).distinct()
    crossing = stored(candidates.join(stars, ["a", "b"], "left_anti"), "crossing")
    roots = connected(links.unionByName(links_of(crossing)), "a", "b")
    scratch.discard("postings", "open", "stars", "groups", "differences", "crossing", "links", "roots", "sets")

    classed = members.join(roots, F.col("set_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "set_id"))
    classed = classed.select("doc_id", "digest", "n", "label")
    firsts = classed.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("first"))
    return classed.join(firsts, "label", "left").select(
        "doc_id", F.col("digest").alias("text_hash"), F.col("n").alias("n_shingles"),
        F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("first")).alias("component_id"), F.col("label").alias("class_key"),
    )


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when each class keeps one document, the one that names it; repeated rows are one."""
    linked = link_documents(docs, doc_id, text, percent)
    document = F.struct("doc_id", "text_hash")
    named = F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), document)), F.min(document))
    kept = linked.filter("class_key is not null").groupBy("class_key").agg(named.alias("held")).select("held.doc_id", "held.text_hash")
    alone = linked.filter("class_key is null").select("doc_id", "text_hash").distinct()
    name, whole, own = unused(docs.columns, "__id", "__digest", "__hash")
    kept = kept.unionByName(alone).select(F.col("doc_id").alias(name), F.col("text_hash").alias(whole))
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(docs[text], F.lit(""))))
    stay = rows.join(kept, rows[doc_id].eqNullSafe(F.col(name)) & (F.col(own) == F.col(whole)), "left_semi")
    return stay.dropDuplicates([doc_id, own]).drop(own)
