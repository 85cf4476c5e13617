"""Column profiles in a fixed number of passes: plain statistics, sketches, and counted values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.operators.aggregates import facts_in_one_pass
from tidewright.operators.ranking import sample_rows, top_n
from tidewright.quality.drift import cells

# Quantiles of a numeric profile and the accuracy of their sketch.
QUANTILES = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
ACCURACY = 10000
# Ranges of distinct values that exact quantiles are looked up in, and the accuracy of their bounds.
RANGES = 128
RANGE_ACCURACY = 1000
DISTINCT_LISTED = 50
TOP_LISTED = 20


def text_columns(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]


FACT_TYPES = {
    **dict.fromkeys(
        ["minimum", "maximum", "mean", "stddev", "total", "skewness", "kurtosis", *QUANTILES],
        "double",
    ),
    **dict.fromkeys(["min_length", "max_length", "mean_length"], "bigint"),
    "median_length": "double",
    **dict.fromkeys(["min_size", "max_size"], "bigint"),
}


def _plain(c: Column, dtype: T.DataType) -> dict[str, Column]:
    out = {"row_count": F.count(F.lit(1)), "non_null": F.count(c)}
    if isinstance(dtype, T.NumericType):
        v = c.cast("double")
        out |= {"minimum": F.min(v), "maximum": F.max(v), "mean": F.avg(v), "total": F.sum(v)}
    elif isinstance(dtype, T.StringType):
        n = F.length(c)
        out |= {"min_length": F.min(n), "max_length": F.max(n), "mean_length": F.round(F.avg(n))}
    elif isinstance(dtype, T.ArrayType):
        out |= {"min_size": F.min(F.size(c)), "max_size": F.max(F.size(c))}
    return out


def _moments(c: Column, dtype: T.DataType) -> dict[str, Column]:
    if not isinstance(dtype, T.NumericType):
        return {}
    v = c.cast("double")
    return {
        "stddev": F.stddev_samp(v),
        "skewness": F.round(F.skewness(v), 4),
        "kurtosis": F.round(F.kurtosis(v), 4),
    }


def _measured(c: Column, dtype: T.DataType) -> tuple[Column, dict[str, float]] | None:
    """What quantiles of a column are taken of, and the shares wanted."""
    if isinstance(dtype, T.NumericType):
        return c.cast("double"), QUANTILES
    if isinstance(dtype, T.StringType):
        return F.length(c), {"median_length": 0.5}
    return None


def _quantiles(c: Column, dtype: T.DataType) -> dict[str, Column]:
    measured = _measured(c, dtype)
    if measured is None:
        return {}
    found = F.percentile_approx(measured[0], list(measured[1].values()), ACCURACY)
    return {name: F.get(found, i) for i, name in enumerate(measured[1])}


def _exact_quantiles(df: DataFrame, measured: dict[str, tuple[Column, dict[str, float]]]) -> DataFrame:
    """(column_name, fact, value) rows: interpolated quantiles of all columns, without a column's values in one task.

    Distinct values are counted in one grouping and fall into ranges of about as many of them. Counts of ranges tell
    which ranges hold the wanted places, and only those are sorted, each by a task of its own.
    """
    held = [F.struct(F.lit(i).alias("i"), v.cast("double").alias("number")) for i, (v, _) in enumerate(measured.values())]
    counts = df.select(F.inline(F.array(*held))).filter("number is not null").groupBy("i", "number").agg(F.count(F.lit(1)).alias("n"))
    # the condition on n keeps the grouping the same in all its uses, so that it is made once
    counted = F.when(F.col("n") > 0, F.col("number"))
    bounds = counts.groupBy("i").agg(F.percentile_approx(counted, [k / RANGES for k in range(1, RANGES)], RANGE_ACCURACY).alias("bounds"))
    placed = counts.join(F.broadcast(bounds), "i").select(
        "i", "number", "n", F.size(F.filter("bounds", lambda b: b < F.col("number"))).alias("range")
    )
    column = Window.partitionBy("i")
    totals = placed.groupBy("i", "range").agg(F.sum("n").alias("held"))
    totals = totals.withColumn("upto", F.sum("held").over(column.orderBy("range"))).withColumn("total", F.sum("held").over(column))
    shares = F.array(*[
        F.array(*[F.struct(F.lit(fact).alias("fact"), F.lit(share).alias("share")) for fact, share in wanted.items()])
        for _, wanted in measured.values()
    ])
    places = totals.select("*", F.inline(F.get(shares, "i"))).withColumn("at", F.col("share") * (F.col("total") - 1))
    places = places.withColumn("place", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at")))))
    places = places.filter("place < upto and place >= upto - held").select("i", "range", "fact", "at", "place", (F.col("upto") - F.col("held")).alias("before"))
    ranges = places.select("i", "range", "before").distinct()
    sorted_ = placed.join(F.broadcast(ranges), ["i", "range"])
    last = F.col("before") + F.sum("n").over(Window.partitionBy("i", "range").orderBy("number"))
    sorted_ = sorted_.select("i", "range", "number", (last - F.col("n")).alias("first"), last.alias("end"))
    found = sorted_.join(F.broadcast(places), ["i", "range"]).filter("place >= first and place < end")
    ends = found.groupBy("i", "fact", "at").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    between = (F.ceil("at") - F.col("at")) * F.col("low") + (F.col("at") - F.floor("at")) * F.col("high")
    names = F.array(*[F.lit(c) for c in measured])
    return ends.select(
        F.get(names, "i").alias("column_name"), "fact", F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(between).alias("value")
    )


def _groupable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.ArrayType, T.MapType, T.StructType))


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, fact, value) rows: exact distinct counts of all columns by one scan and one shuffle of their values."""
    floating = {c: isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)) for c in columns}
    held = [
        F.struct(
            F.lit(i).alias("i"),
            (F.col(f"`{c}`").cast("double") if floating[c] else F.lit(None).cast("double")).alias("number"),
            (F.lit(None).cast("string") if floating[c] else F.col(f"`{c}`").cast("string")).alias("text"),
        )
        for i, c in enumerate(columns)
    ]
    cells = df.select(F.inline(F.array(*held))).filter("number is not null or text is not null")
    counts = cells.groupBy("i", "number", "text").agg(F.lit(1).alias("one")).groupBy("i").agg(F.count(F.lit(1)).alias("n"))
    names = F.array(*[F.lit(c) for c in columns])
    return counts.select(F.get(names, "i").alias("column_name"), F.lit("distinct_count").alias("fact"), F.col("n").cast("double").alias("value"))


def _facts(df: DataFrame, facts: dict[str, dict[str, Column]]) -> list[DataFrame]:
    """(column_name, fact, value) rows of all columns, by one aggregation."""
    rows = [
        F.struct(F.lit(n).alias("column_name"), F.lit(fact).alias("fact"), value.cast("double").alias("value"))
        for n, found in facts.items()
        for fact, value in found.items()
    ]
    return [facts_in_one_pass(df, rows)] if rows else []


def profile_columns(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False
) -> DataFrame:
    """One row per column, in a single action of three scans at most, whatever the number of columns.

    Sketches are used for distinct counts, quantiles and median lengths; distinct floating numbers are
    always counted. ``exact=True`` counts all distinct values, in one grouping for all columns, and takes
    exact quantiles from another one, in ranges of values; its shuffle is used again, not made again.
    """
    names = list(columns or df.columns)
    col = {n: F.col(f"`{n}`") for n in names}
    dtype = {n: df.schema[n].dataType for n in names}
    countable = [n for n in names if _groupable(dtype[n])]
    parts = _facts(df, {n: _plain(col[n], dtype[n]) | _moments(col[n], dtype[n]) for n in names})
    # a sketch of floating numbers is not what the contract asks for: they are always counted
    counted = [n for n in countable if exact or isinstance(dtype[n], (T.FloatType, T.DoubleType))]
    if counted:
        parts.append(_distinct_counts(df, counted))
    sketched = {n: {"distinct_count": F.approx_count_distinct(col[n])} for n in countable if n not in counted}
    # sketches are not compiled with the plain aggregates, so they get a pass of their own
    parts += _facts(df, {n: ({} if exact else _quantiles(col[n], dtype[n])) | sketched.get(n, {}) for n in names})
    measured = {n: m for n in names if exact and (m := _measured(col[n], dtype[n])) is not None}
    if measured:
        parts.append(_exact_quantiles(df, measured))
    facts = reduce(lambda a, b: a.unionAll(b), parts)

    def fact(name: str) -> Column:
        return F.max(F.when(F.col("fact") == name, F.col("value")))

    kinds = F.create_map(*[F.lit(x) for n in names for x in (n, dtype[n].simpleString())])
    gathered = facts.groupBy("column_name").agg(
        *[
            fact(name).cast(kind).alias(name)
            for name, kind in {
                "row_count": "bigint",
                "non_null": "bigint",
                "distinct_count": "bigint",
                **FACT_TYPES,
            }.items()
        ]
    )
    complete = F.col("non_null") / F.nullif(F.col("row_count"), F.lit(0))
    return gathered.select(
        "column_name",
        F.try_element_at(kinds, F.col("column_name")).alias("data_type"),
        "row_count",
        "non_null",
        F.coalesce(complete, F.lit(0.0)).alias("completeness"),
        F.when(F.col("column_name").isin(*countable), F.coalesce("distinct_count", F.lit(0))).alias("distinct_count"),
        *FACT_TYPES,
    )


def _counted_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (
        cells(df, columns)
        .filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def frequent_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Most frequent values of every column with their share of the non-null rows.

    A column with few distinct values lists all of them, any other its most frequent ones; equal
    counts are ordered by value.
    """
    columns = list(columns or df.columns)
    counts = _counted_values(df, columns)
    order = [F.col("n").desc(), F.col("value").asc()]
    kept = top_n(counts, ["column_name"], order, DISTINCT_LISTED, rank="rank")
    totals = counts.groupBy("column_name").agg(
        F.sum("n").alias("non_null"), F.count(F.lit(1)).alias("distinct_count")
    )
    limit = F.when(F.col("distinct_count") <= DISTINCT_LISTED, DISTINCT_LISTED).otherwise(TOP_LISTED)
    return (
        kept.join(totals, "column_name")
        .filter(F.col("rank") <= limit)
        .select(
            "column_name",
            "value",
            F.col("n").alias("row_count"),
            F.round(F.col("n") / F.col("non_null"), 4).alias("fraction"),
            "rank",
        )
    )


def sample_values(df: DataFrame, columns: Sequence[str], n: int = 10, seed: int = 42) -> DataFrame:
    """A reproducible sample of distinct values per column, without a global sort."""
    counts = _counted_values(df, columns)
    return sample_rows(counts, ["column_name"], "value", n, seed).select("column_name", "value")


def shape(c: Column) -> Column:
    """Structure of a text: A for upper case, a for lower case, N for a digit."""
    upper = F.regexp_replace(c, r"\p{Lu}", "A")
    return F.regexp_replace(F.regexp_replace(upper, r"\p{Ll}", "a"), r"\p{Nd}", "N")


def collapsed(c: Column) -> Column:
    """Runs of three or more of a class become the class and a plus."""
    for letter in "AaN":
        c = F.regexp_replace(c, letter + "{3,}", letter + "+")
    return c


# Share of values a pattern needs to be reported, plain and collapsed.
DOMINANT_SHARE = 0.8
COLLAPSED_SHARE = 0.6


def patterns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The dominant structural pattern of each text column over all of its rows, if there is one."""
    columns = list(columns or text_columns(df.schema))
    shaped = df.select(*[shape(F.col(c)).alias(c) for c in columns])
    counts = _counted_values(shaped, columns)
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    order = [F.col("n").desc(), F.col("pattern").asc()]
    plain = counts.withColumnRenamed("value", "pattern")
    short = (
        counts.groupBy("column_name", collapsed(F.col("value")).alias("pattern"))
        .agg(F.sum("n").alias("n"))
    )
    best_plain = top_n(plain, ["column_name"], order).select(
        "column_name", F.col("pattern").alias("plain"), F.col("n").alias("plain_n")
    )
    best_short = top_n(short, ["column_name"], order).select(
        "column_name", F.col("pattern").alias("short"), F.col("n").alias("short_n")
    )
    # one row per column on every side
    joined = totals.join(best_plain, "column_name").join(best_short, "column_name")
    plain_share = F.col("plain_n") / F.col("total")
    short_share = F.col("short_n") / F.col("total")
    return joined.select(
        "column_name",
        F.when(plain_share >= DOMINANT_SHARE, F.col("plain"))
        .when(short_share >= COLLAPSED_SHARE, F.col("short"))
        .alias("pattern"),
        F.round(
            F.when(plain_share >= DOMINANT_SHARE, plain_share).otherwise(short_share), 4
        ).alias("share"),
    )


# Pattern classes and the characters they stand for.
CLASSES = {"A": "[A-Z]", "a": "[a-z]", "N": "[0-9]"}
_SPECIAL = set(r"\.^$|?*+()[]{}")


def pattern_regex(pattern: str) -> str:
    """Anchored regular expression of a structural pattern."""
    out, previous = [], ""
    for ch in pattern:
        if ch == "+" and previous:
            out.append("+")
            previous = ""
            continue
        out.append(CLASSES.get(ch) or ("\\" + ch if ch in _SPECIAL else ch))
        previous = ch
    return "^" + "".join(out) + "$"


def conformance(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Share of non-null rows of each column that match its pattern, all in one aggregate."""
    rows = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(pattern).alias("pattern"),
            F.count(name).alias("non_null"),
            F.count_if(F.col(name).rlike(pattern_regex(pattern))).alias("matching"),
        )
        for name, pattern in expressions.items()
    ]
    facts = facts_in_one_pass(df, rows)
    share = F.round(F.col("matching") / F.nullif(F.col("non_null"), F.lit(0)), 6)
    return facts.withColumn("share", share)


def embedding_facts(df: DataFrame, column: str) -> DataFrame:
    """NULLs, observed sizes and readiness of a vector column, in one aggregate."""
    c = F.col(column)
    return df.agg(
        F.lit(column).alias("column_name"),
        F.count_if(c.isNull()).alias("null_count"),
        F.min(F.size(c)).alias("min_size"),
        F.max(F.size(c)).alias("max_size"),
    )


def corpus_advisories(df: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """Readiness of a corpus: the key is complete, vectors have one size, divisible by 16."""
    keyed = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in key]) if key else F.lit(True)
    n = F.size(F.col(column))
    facts = df.agg(
        F.count_if(keyed).alias("keyless"), F.min(n).alias("lo"), F.max(n).alias("hi")
    )
    rows = F.array(
        F.struct(
            F.lit("key_present").alias("advisory"),
            (F.col("keyless") == 0).alias("ok"),
            F.col("keyless").cast("string").alias("observed"),
        ),
        F.struct(
            F.lit("one_size").alias("advisory"),
            (F.col("lo") == F.col("hi")).alias("ok"),
            F.concat_ws("-", "lo", "hi").alias("observed"),
        ),
        F.struct(
            F.lit("multiple_of_16").alias("advisory"),
            (F.col("hi") % 16 == 0).alias("ok"),
            F.col("hi").cast("string").alias("observed"),
        ),
    )
    return facts.select(F.inline(rows))
