"""Candidate keys, searched level by level: estimated by sketches, verified exactly where an estimate cannot tell."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from math import ceil, prod
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH_BONUS = 0.05
# The least score and the least lead over the next candidate for a promotion.
MIN_SCORE = 0.9
MIN_GAP = 0.05

SKETCH_LG_K = 12
#: an estimate this far below the row count rules a set out: over ten standard errors (1.04 / sqrt(2**12)) of the sketch
SURE = 0.17
#: one of so many parts of the tuples, chosen by their hash, is searched for repeats first
PARTS = 16
#: sketches in one aggregate
SKETCHES = 64
#: so many tuples (rows times sets) are grouped in one shuffle of their hashes; for more, whole rows are dealt by an anchor
AT_ONCE = 1 << 23
#: tables of so many cells at most are spread over the cores if few tasks read them
SPREAD = 1 << 26
#: values of an anchor fall into so many slots; a scan deals the rows of some of them
SLOTS = 256
#: scans per anchor, so that at most this part of a table's rows is in shuffle files at a time
SCANS = 3
#: sets whose tuples are made in one shuffle; the JVM does not compile the code for many more
TOGETHER = 24
#: tuples in a task
HELD = 1 << 19
#: values of an anchor fall into so many buckets; one with more than a HEAVY-th of the rows is not dealt
BUCKETS = 4096
HEAVY = 512
#: columns of so many values are anchors of any set they are in
MANY = 1 << 14
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

KEY_SCHEMA = T.StructType(
    [
        T.StructField("columns", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("distinct_count", T.LongType()),
        T.StructField("verified", T.BooleanType()),
        T.StructField("is_unique", T.BooleanType()),
        T.StructField("minimal", T.BooleanType()),
        T.StructField("nullable", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ]
)


def _hashable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.VariantType))


def _hashed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two 64-bit hashes of every column; sets of columns are hashed from these."""
    return df.select(*[
        h.alias(f"{side}{i}")
        for i, c in enumerate(columns)
        for side, h in (("a", F.xxhash64(F.col(f"`{c}`"))), ("b", F.xxhash64(F.lit("b"), F.col(f"`{c}`"))))
    ])


@dataclass(frozen=True)
class _Rows:
    """The complete columns of a table as ``c0``, ``c1``, ..., with their estimated distinct counts and heavy buckets."""

    df: DataFrame
    hashed: DataFrame
    rows: int
    sizes: dict[int, int] = field(default_factory=dict)
    heavy: dict[int, list[int]] = field(default_factory=dict)


@contextmanager
def _files_go_at_once(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with the action that wrote them, not when the driver happens to collect its garbage."""
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)


def _estimates(hashed: DataFrame, sets: Sequence[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """Distinct counts by one mergeable sketch per set, all in one wide aggregate (one more per ``SKETCHES`` sets)."""
    found: dict[tuple[int, ...], int] = {}
    for start in range(0, len(sets), SKETCHES):
        part = sets[start : start + SKETCHES]
        # hashed in a projection, whose code is generated; the aggregate would interpret the expressions row by row
        tuples = hashed.select(*[F.xxhash64(*[F.col(f"a{i}") for i in s]).alias(f"t{k}") for k, s in enumerate(part)])
        row = tuples.agg(F.array(*[F.hll_sketch_estimate(F.hll_sketch_agg(f"t{k}", SKETCH_LG_K)) for k in range(len(part))])).first()
        found.update(zip(part, row[0], strict=True))
    return found


def _tuple(k: int, s: tuple[int, ...], chosen: Column | None = None) -> Column:
    """A set's number and 128-bit hash of the tuple, whose half ``b`` is NULL unless ``chosen``."""
    a, b = (F.xxhash64(*[F.col(f"{side}{i}") for i in s]) for side in "ab")
    return F.struct(F.lit(k).alias("k"), a.alias("a"), (b if chosen is None else F.when(chosen, b)).alias("b"))


def _anchors(table: _Rows, sets: Sequence[tuple[int, ...]]) -> dict[int, list[tuple[int, ...]]]:
    """Few columns, found greedily, of which every set has one; each with its sets."""

    def fit(s: tuple[int, ...]) -> list[int]:
        return [i for i in s if table.sizes.get(i, 0) >= MANY] or [max(s, key=lambda i: table.sizes.get(i, 0))]

    found: dict[int, list[tuple[int, ...]]] = {}
    left = list(sets)
    while left:
        votes = Counter(i for s in left for i in fit(s))
        best = max(votes, key=lambda i: (votes[i], table.sizes.get(i, 0)))
        found[best] = [s for s in left if best in fit(s)]
        left = [s for s in left if best not in fit(s)]
    return found


def _find_heavy(table: _Rows, columns: Sequence[int]) -> None:
    """Buckets of the columns' values that hold too many rows for one task, all in one scan."""
    new = [i for i in columns if i not in table.heavy]
    if not new:
        return
    each = [F.struct(F.lit(i).alias("i"), F.pmod(F.xxhash64(f"c{i}"), F.lit(BUCKETS)).alias("bucket")) for i in new]
    counts = table.df.select(F.inline(F.array(*each))).groupBy("i", "bucket").agg(F.count(F.lit(1)).alias("n"))
    table.heavy.update({i: [] for i in new})
    for r in counts.filter(F.col("n") * HEAVY > table.rows).collect():
        table.heavy[r["i"]].append(r["bucket"])


def _repeats(table: _Rows, sets: Sequence[tuple[int, ...]], first: int, last: int) -> Counter[tuple[int, ...]]:
    """Rows beyond the first of their tuple, by set, in the slots from ``first`` to before ``last``; all slots hold all rows.

    Equal tuples have equal values in the set's anchor. So rows are dealt by the anchor's value, once for all its sets,
    and the tuples are made and grouped where they meet: the shuffle holds rows, not tuples. Rows of heavy buckets would
    meet in few tasks; their tuples are shuffled by hash instead, and their slot is that of the tuple.
    """
    if len(sets) > TOGETHER:
        return sum((_repeats(table, sets[i : i + TOGETHER], first, last) for i in range(0, len(sets), TOGETHER)), Counter())
    by = _anchors(table, sets)
    _find_heavy(table, list(by))
    used = sorted({i for s in sets for i in s})
    df = table.df.select(*[f"c{i}" for i in used])

    def falls(h: Column) -> Column:
        slot = F.pmod(h, F.lit(SLOTS))
        return (slot >= first) & (slot < last)

    def heavy(anchor: int) -> Column:
        return F.pmod(F.xxhash64(f"c{anchor}"), F.lit(BUCKETS)).isin(table.heavy[anchor]) if table.heavy[anchor] else F.lit(False)

    def hashes(i: int) -> list[Column]:
        return [F.xxhash64(f"c{i}").alias(f"a{i}"), F.xxhash64(F.lit("b"), f"c{i}").alias(f"b{i}")]

    def repeats(groups: DataFrame) -> DataFrame:
        return groups.agg(F.count(F.lit(1)).alias("n")).groupBy("k").agg(F.sum(F.col("n") - 1).alias("repeats"))

    number = {s: k for k, s in enumerate(sets)}
    light = {anchor: falls(F.xxhash64(f"c{anchor}")) & ~heavy(anchor) for anchor in by}
    deals = [F.struct(F.lit(anchor).alias("anchor"), F.when(c, F.xxhash64(f"c{anchor}")).alias("at")) for anchor, c in light.items()]
    copies = df.filter(reduce(or_, light.values())).select("*", F.inline(F.array(*deals))).filter("at is not null")
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, ceil(table.rows * len(sets) * (last - first) / SLOTS / HELD))
    met = copies.repartition(tasks, "at").select("anchor", "at", *[h for i in used for h in hashes(i)])
    tuples = F.coalesce(*[F.when(F.col("anchor") == anchor, F.array(*[_tuple(number[s], s) for s in its])) for anchor, its in by.items()])
    found = repeats(met.select("at", F.inline(tuples)).groupBy("at", "k", "a", "b")).collect()
    if many := {anchor: its for anchor, its in by.items() if table.heavy[anchor]}:
        rest = df.filter(reduce(or_, [heavy(anchor) for anchor in many]))
        rest = rest.select(*[heavy(anchor).alias(f"heavy{anchor}") for anchor in many], *[h for i in used for h in hashes(i)])
        each = [
            _tuple(number[s], s, F.col(f"heavy{anchor}") & falls(F.xxhash64(*[F.col(f"a{i}") for i in s]))) for anchor, its in many.items() for s in its
        ]
        found += repeats(rest.select(F.inline(F.array(*each))).filter("b is not null").groupBy("k", "a", "b")).collect()
    total: Counter[tuple[int, ...]] = Counter()
    for r in found:
        total[sets[r["k"]]] += r["repeats"]
    return total


def _repeated(table: _Rows, sets: Sequence[tuple[int, ...]]) -> set[tuple[int, ...]]:
    """Sets with a repeat among the tuples of one part: proof that they are no keys, for a fraction of the shuffle."""
    if table.rows * len(sets) > AT_ONCE:
        out: set[tuple[int, ...]] = set()
        for first, last in ((0, 1), (1, SLOTS // PARTS)):  # most sets fall by very few rows
            left = [s for s in sets if s not in out]
            out |= {s for s, n in _repeats(table, left, first, last).items() if n} if left else set()
        return out
    each = [_tuple(k, s, F.pmod(F.xxhash64(*[F.col(f"a{i}") for i in s]), F.lit(PARTS)) == 0) for k, s in enumerate(sets)]
    groups = table.hashed.select(F.inline(F.array(*each))).filter("b is not null").groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    return {sets[r["k"]] for r in groups.filter("n > 1").select("k").distinct().collect()}


def _distinct(table: _Rows, sets: Sequence[tuple[int, ...]]) -> dict[tuple[int, ...], int]:
    """Exact distinct counts of all sets: in one scan and one shuffle of (set, 128-bit hash of the tuple), or slot by slot."""
    if table.rows * len(sets) > AT_ONCE:
        scans, total = SCANS * len(_anchors(table, sets)), Counter()
        for k in range(scans):
            total += _repeats(table, sets, SLOTS * k // scans, SLOTS * (k + 1) // scans)
        return {s: table.rows - total[s] for s in sets}
    each = [_tuple(k, s) for k, s in enumerate(sets)]
    groups = table.hashed.select(F.inline(F.array(*each))).groupBy("k", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    repeats = groups.groupBy("k").agg(F.sum(F.col("n") - 1).alias("repeats"))
    return {sets[r["k"]]: table.rows - r["repeats"] for r in repeats.collect()}


def key_candidates(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_width: int = 3,
    exact_counts: bool = False,
    count_repeated: bool = True,
) -> DataFrame:
    """Column sets that identify a row, up to ``max_width`` columns, each marked minimal or not.

    Only complete columns take part. A level holds the sets without a unique subset, so every unique set found is minimal.
    Sets whose parts cannot have enough combinations of values are ruled out by the counts of the levels below; the others
    are estimated together, and only those within ``SURE`` of the row count are counted, together again. So a level is
    two scans, plus one per further ``SKETCHES`` sets. Above ``AT_ONCE`` tuples (rows times sets) counting shuffles rows
    instead, in ``SCANS`` scans per anchor column and ``TOGETHER`` sets, each of whose shuffle files go before the next.
    ``distinct_count`` is exact for counted sets and an estimate for others;
    ``exact_counts`` counts every set that is not ruled out. Without ``count_repeated``, for callers that want the keys
    only, sets of several columns in which one part of the tuples holds a repeat are known to be no keys and keep their
    estimate (one scan more, or two); the keys are the same. Tables that few tasks read are spread over the cores
    first, up to ``SPREAD`` cells.
    """
    with _files_go_at_once(df.sparkSession):
        return _search(df, columns or df.columns, max_width, exact_counts, count_repeated)


def _search(df: DataFrame, columns: Sequence[str], max_width: int, exact_counts: bool, count_repeated: bool) -> DataFrame:
    names = [c for c in columns if _hashable(df.schema[c].dataType)]
    read = df.select(F.spark_partition_id().alias("task"), *[F.col(f"`{c}`").alias(f"c_{i}") for i, c in enumerate(names)])
    by_task = read.groupBy("task").agg(F.count(F.lit(1)).alias("n"), *[F.count(f"c_{i}").alias(f"c_{i}") for i in range(len(names))])
    facts = by_task.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("tasks"),
        *[F.coalesce(F.sum(f"c_{i}"), F.lit(0)).alias(f"c_{i}") for i in range(len(names))],
    ).first()
    rows, cores = facts["n"], df.sparkSession.sparkContext.defaultParallelism
    complete = [c for i, c in enumerate(names) if facts[f"c_{i}"] == rows]
    spread = df.select(*[F.col(f"`{c}`") for c in complete])
    few = facts["tasks"] < cores and rows * len(complete) <= SPREAD
    hashed = _hashed(spread.repartition(cores) if few else spread, complete)
    table = _Rows(spread.toDF(*[f"c{i}" for i in range(len(complete))]), hashed, rows)
    found: list[tuple] = []
    unique: list[tuple[int, ...]] = []
    known: dict[tuple[int, ...], int] = {}

    def score(s: tuple[int, ...]) -> float:
        ratio = sum(known[i,] / rows for i in s if (i,) in known)
        return round(ratio + WIDTH_BONUS * (len(s) - 1), 6)

    def most(s: tuple[int, ...]) -> float:
        """Combinations that the parts of a set allow; sketches may be off by ``SURE``."""
        if len(s) == 1:
            return rows
        splits = [(t, tuple(i for i in s if i not in t)) for w in range(1, len(s) // 2 + 1) for t in combinations(s, w)]
        slack = 1.0 if exact_counts else 1 / (1 - SURE)
        return min([prod(known[i,] for i in s) * slack ** len(s), *[known[t] * known[r] * slack**2 for t, r in splits if t in known and r in known]])

    for width in range(1, max_width + 1):
        level = [s for s in combinations(range(len(complete)), width) if not any(set(u) <= set(s) for u in unique)] if rows else []
        possible = [s for s in level if most(s) >= rows]
        for s in level:
            if s not in possible:
                found.append((s, None, False, "too few combinations of values"))
        near = possible
        if not exact_counts and possible:
            known.update(_estimates(hashed, possible))
            near = [s for s in possible if known[s] >= (1 - SURE) * rows]
            for s in possible:
                if s not in near:
                    found.append((s, known[s], False, "estimated far below the row count"))
        if near and width > 1 and not (exact_counts or count_repeated):
            repeated = _repeated(table, near)
            found += [(s, known[s], False, "duplicates found") for s in near if s in repeated]
            near = [s for s in near if s not in repeated]
        if near:
            known.update(_distinct(table, near))
        table.sizes.update({s[0]: known[s] for s in possible if width == 1})
        for s in near:
            found.append((s, known[s], known[s] == rows, "no smaller unique set" if known[s] == rows else "duplicates found"))
            if known[s] == rows:
                unique.append(s)
    return df.sparkSession.createDataFrame(
        [(",".join(complete[i] for i in s), len(s), score(s), n, True, is_unique, is_unique, False, reason) for s, n, is_unique, reason in found],
        KEY_SCHEMA,
    )


def promote_key(candidates: DataFrame, min_score: float = MIN_SCORE, min_gap: float = MIN_GAP) -> DataFrame:
    """The key to adopt, if one verified minimal candidate clearly leads."""
    fit = candidates.filter(
        F.col("verified") & F.col("is_unique") & F.col("minimal") & ~F.col("nullable")
        & (F.col("score") >= min_score)
    )
    ranked = F.reverse(F.array_sort(F.collect_list(F.struct("score", "columns"))))
    best = fit.agg(ranked.alias("r"))
    lead = F.get("r", 0)["score"] - F.coalesce(F.get("r", 1)["score"], F.lit(float("-inf")))
    clear = (F.size("r") == 1) | (lead >= min_gap)
    return best.select(
        (F.size("r") > 0).alias("any_fit"),
        ((F.size("r") > 0) & clear).alias("promoted"),
        F.when(clear, F.get("r", 0)["columns"]).alias("columns"),
        F.when(F.size("r") == 0, "no candidate qualified")
        .when(clear, "clear lead")
        .otherwise("lead too small")
        .alias("reason"),
    )
