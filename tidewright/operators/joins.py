"""Equi-joins between a base table and others, referential checks and key discovery."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.ranking import newest_first, top_n
from tidewright.session import cut_lineage


def namespaced(df: DataFrame, alias: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns exposed as ``<alias>__<column>``; provenance columns always come along."""
    wanted = list(columns) if columns is not None else list(df.columns)
    wanted += [c for c in df.columns if c.startswith("meta_") and c not in wanted]
    return df.select(*[F.col(c).alias(f"{alias}__{c}") for c in wanted])


def enrich(
    base: DataFrame,
    other: DataFrame,
    on: dict[str, str],
    alias: str,
    columns: Sequence[str] | None = None,
    how: str = "left",
    where: str | None = None,
) -> DataFrame:
    """Join ``other`` under ``alias``; ``on`` maps base columns to its columns.

    ``where`` restricts the joined table before the join, so a left join keeps every base row.
    Joining the same table again under another alias gives a second, independent instance.
    """
    right = other.filter(F.expr(where)) if where else other
    keys = list(on.values())
    shown = list(columns) if columns is not None else list(other.columns)
    right = namespaced(right, alias, list(dict.fromkeys([*keys, *shown])))
    condition = [F.col(b) == F.col(f"{alias}__{o}") for b, o in on.items()]
    joined = base.join(right, condition, how)
    return joined.drop(*[f"{alias}__{k}" for k in keys if k not in shown])


def first_record(
    base: DataFrame,
    other: DataFrame,
    on: dict[str, str],
    alias: str,
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] | None = None,
    how: str = "left",
    where: str | None = None,
) -> DataFrame:
    """Join one row of ``other`` per key.

    Without ``order_by`` the row is the first by a type column, else a name column, else the first
    column outside the key, then by the key and every column, ascending with NULL last.
    """
    keys = list(on.values())
    rows = other.filter(F.expr(where)) if where else other
    if order_by:
        order = newest_first(rows, order_by)
    else:
        free = [c for c in other.columns if c not in keys]
        lead = next((c for c in free if "type" in c.lower()), None)
        lead = lead or next((c for c in free if "name" in c.lower()), None) or free[0]
        order = [F.col(c).asc_nulls_last() for c in dict.fromkeys([lead, *keys, *other.columns])]
    return enrich(base, top_n(rows, keys, order), on, alias, columns, how)


def bridge_aggregate(
    source: DataFrame,
    lookup: DataFrame,
    source_key: str,
    target_key: str,
    lookup_key: str,
    aggregates: Sequence[Column],
    combine: Sequence[Column] | None = None,
    partial: Sequence[Column] | None = None,
) -> DataFrame:
    """Aggregate ``source`` by a key that only a lookup table knows.

    With ``partial`` and ``combine`` the source is reduced by its own key first, so the join
    carries one row per key instead of every source row.
    """
    side = lookup.select(F.col(target_key).alias("_tw_target"), lookup_key)
    if partial and combine:
        reduced = source.groupBy(F.col(source_key).alias("_tw_source")).agg(*partial)
        joined = reduced.join(side, F.col("_tw_source") == F.col("_tw_target"))
        return joined.groupBy(lookup_key).agg(*combine)
    joined = source.join(side, F.col(source_key) == F.col("_tw_target"))
    return joined.groupBy(lookup_key).agg(*aggregates)


def orphans(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child rows whose complete foreign key finds no parent."""
    keyed = child.dropna(subset=list(on))
    parents = parent.select(*[F.col(p).alias(f"_tw_{p}") for p in on.values()])
    return keyed.join(parents, [F.col(c) == F.col(f"_tw_{p}") for c, p in on.items()], "left_anti")


def fk_coverage(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """One row: rows with a key, rows that find a parent, orphan rows, and the covered share.

    Child rows are counted per key first, so a hot key crosses the join once.
    """
    keys = list(on)
    counted = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    keyed = counted.dropna(subset=keys)
    parents = (
        parent.select(*[F.col(p).alias(f"_tw_{p}") for p in on.values()])
        .dropna()
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    joined = keyed.join(parents, [F.col(c) == F.col(f"_tw_{p}") for c, p in on.items()], "left")
    hit = F.when(F.col("_hit"), F.col("_n")).otherwise(0)
    return joined.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("keyed_rows"),
        F.coalesce(F.sum(hit), F.lit(0)).alias("matched_rows"),
    ).select(
        "keyed_rows",
        "matched_rows",
        (F.col("keyed_rows") - F.col("matched_rows")).alias("orphan_rows"),
        F.when(F.col("keyed_rows") > 0, F.round(F.col("matched_rows") / F.col("keyed_rows"), 6))
        .otherwise(F.lit(1.0))
        .alias("coverage"),
    )


@dataclass(frozen=True)
class KeyPair:
    """A column that may refer to another table's key."""

    child: str
    child_column: str
    parent: str
    parent_column: str


def name_likeness(pair: KeyPair) -> float:
    """Prior from the names alone: 1.0 same name without prefix, 0.5 a shared last word."""

    def bare(column: str) -> str:
        head, _, tail = column.partition("_")
        return (tail if len(head) <= 2 and tail else column).lower()

    child, parent = bare(pair.child_column), bare(pair.parent_column)
    if child == parent:
        return 1.0
    return 0.5 if child.endswith(parent) or parent.endswith(child) else 0.0


PAIR_FACTS = (
    "child_table string, child_column string, parent_table string, parent_column string, name_score double, child_values long, "
    "parent_values long, shared_values long, inclusion double, cardinality string"
)


def measure_foreign_keys(frames: dict[str, DataFrame], pairs: Sequence[KeyPair]) -> DataFrame:
    """Measure every candidate pair on the data: inclusion, and how many children per parent.

    Every table is read once, as (column, value) rows, and all are grouped once by value, with partial
    counts before the shuffle; each value then knows which columns hold it, and the pairs are counted
    in a single aggregate. Work grows with distinct values, not with pairs times rows.
    """
    columns = list(
        dict.fromkeys(
            [(p.child, p.child_column) for p in pairs]
            + [(p.parent, p.parent_column) for p in pairs]
        )
    )
    slot = {c: i for i, c in enumerate(columns)}
    held = []
    for table in dict.fromkeys(t for t, _ in columns):
        cells = [
            F.struct(F.lit(slot[t, c]).alias("slot"), F.col(f"`{c}`").cast("string").alias("v")) for t, c in columns if t == table
        ]
        held.append(frames[table].select(F.inline(F.array(*cells))).filter(F.col("v").isNotNull()))
    per_value = reduce(DataFrame.unionAll, held).groupBy("v").agg(
        *[F.sum(F.when(F.col("slot") == i, F.lit(1))).alias(f"n{i}") for i in range(len(columns))]
    )
    rows = []
    for p in pairs:
        child = F.col(f"n{slot[p.child, p.child_column]}")
        parent = F.col(f"n{slot[p.parent, p.parent_column]}")
        rows.append(
            F.struct(
                F.lit(p.child).alias("child_table"),
                F.lit(p.child_column).alias("child_column"),
                F.lit(p.parent).alias("parent_table"),
                F.lit(p.parent_column).alias("parent_column"),
                F.lit(name_likeness(p)).alias("name_score"),
                F.count(child).alias("child_values"),
                F.count(parent).alias("parent_values"),
                F.count_if(child.isNotNull() & parent.isNotNull()).alias("shared_values"),
                F.max(child).alias("most_children"),
                F.max(parent).alias("most_parents"),
            )
        )
    facts = per_value.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    inclusion = F.round(F.col("shared_values") / F.nullif(F.col("child_values"), F.lit(0)), 6)
    kind = (
        F.when(F.col("most_parents") > 1, "N:M")
        .when(F.col("most_children") > 1, "1:N")
        .when(F.col("shared_values") < F.col("parent_values"), "1:0..1")
        .otherwise("1:1")
    )
    return facts.select(
        "child_table",
        "child_column",
        "parent_table",
        "parent_column",
        "name_score",
        "child_values",
        "parent_values",
        "shared_values",
        F.coalesce(inclusion, F.lit(0.0)).alias("inclusion"),
        kind.alias("cardinality"),
    )


#: sketches hold so many hashes (2 ** 12) of a column, exact for columns with fewer values
FK_SKETCH = 12
#: estimates may miss the truth by this share; twelve standard errors of the sketch
FK_SLACK = 0.2


def _key_family(dtype: T.DataType) -> str | None:
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    return "text" if isinstance(dtype, T.StringType) else None


def column_sketches(frames: dict[str, DataFrame]) -> DataFrame:
    """table, column, family, rows, values, sketch: a sketch of the values of every column fit for a key, one scan per table."""
    parts = []
    for table, df in frames.items():
        fit = [(f.name, family) for f in df.schema.fields if (family := _key_family(f.dataType))]
        cells = [
            F.struct(
                F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(family).alias("family"), F.count(F.lit(1)).alias("rows"),
                F.count(F.col(f"`{c}`")).alias("filled"), F.theta_sketch_agg(F.col(f"`{c}`").cast("string"), FK_SKETCH).alias("sketch"),
            )
            for c, family in fit
        ]
        if cells:
            parts.append(df.agg(F.array(*cells).alias("cells")).select(F.inline("cells")))
    return reduce(DataFrame.unionAll, parts).withColumn("values", F.theta_sketch_estimate("sketch"))


def likely_foreign_keys(frames: dict[str, DataFrame], min_inclusion: float = 1.0) -> list[KeyPair]:
    """Column pairs that their sketches do not rule out; they come to the driver as names.

    The sketch of a subset never holds a hash that its superset's lacks below both thresholds, so for whole inclusion
    one such hash is proof. Parents must be about as distinct as their rows.
    """
    sketches = cut_lineage(column_sketches(frames))
    child, parent = sketches.alias("c"), sketches.alias("p")
    other = (F.col("c.table") != F.col("p.table")) | (F.col("c.column") != F.col("p.column"))
    missing = F.theta_sketch_estimate(F.theta_difference(F.col("c.sketch"), F.col("p.sketch")))
    near = F.lit(0) if min_inclusion >= 1 else (1 - min_inclusion + FK_SLACK) * F.col("c.values")
    found = (
        child.join(parent, (F.col("c.family") == F.col("p.family")) & other)
        .filter((F.col("c.values") > 0) & (F.col("p.values") >= (1 - FK_SLACK) * F.col("p.filled")))
        .filter(missing <= near)
        .select(*[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in ("c", "p") for c in ("table", "column")])
    )
    return [KeyPair(*r) for r in sorted(map(tuple, found.collect()))]


def discover_foreign_keys(frames: dict[str, DataFrame], min_inclusion: float = 1.0) -> DataFrame:
    """All column pairs of the tables where the child's values lie in a unique column, measured as in ``measure_foreign_keys``.

    Two scans per table: one for sketches, one for the pairs that these leave.
    """
    pairs = likely_foreign_keys(frames, min_inclusion)
    if not pairs:
        return next(iter(frames.values())).sparkSession.createDataFrame([], PAIR_FACTS)
    found = measure_foreign_keys(frames, pairs)
    return found.filter((F.col("shared_values") >= min_inclusion * F.col("child_values")) & (F.col("cardinality") != "N:M"))
