"""Semantic types of columns, scored from names, descriptions and all of their values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.operators.aggregates import facts_in_one_pass
from tidewright.functions.domains import (
    DOMAINS,
    NAME_WEIGHT,
    TEXT_WEIGHT,
    VALUE_SHARE,
    VALUE_WEIGHT,
    Domain,
    name_matches,
    text_matches,
)


def value_scores(df: DataFrame, columns: Sequence[str], domains: Sequence[Domain] = DOMAINS) -> DataFrame:
    """For every column and domain with a value pattern: how many rows match it, in one pass."""
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.lit(d.name).alias("domain"),
            F.count(c).alias("non_null"),
            F.count_if(F.col(c).cast("string").rlike(d.sample)).alias("matching"),
        )
        for c in columns
        for d in domains
        if d.sample
    ]
    facts = facts_in_one_pass(df, rows)
    share = F.coalesce(F.col("matching") / F.nullif(F.col("non_null"), F.lit(0)), F.lit(0.0))
    return facts.withColumn("share", F.round(share, 6))


def registry_frame(spark, domains: Sequence[Domain] = DOMAINS) -> DataFrame:
    """The registry as rows. Its size is fixed by the registry."""
    rows = [
        (i, d.name, d.sample, d.regex, ",".join(d.values) or None, d.base_type, d.severity)
        for i, d in enumerate(domains)
    ]
    return spark.createDataFrame(
        rows,
        "position int, domain string, sample string, regex string, value_set string, "
        "base_type string, severity string",
    )


def infer_domains(
    df: DataFrame,
    columns: Sequence[str],
    descriptions: dict[str, str] | None = None,
    domains: Sequence[Domain] = DOMAINS,
) -> DataFrame:
    """Best and second-best domain per column with the reasons.

    Each signal that is available contributes its weight; the score is the matched weight over
    the available weight. Earlier registry entries win ties.
    """
    descriptions = descriptions or {}
    signals = []
    for c in columns:
        for position, d in enumerate(domains):
            told = descriptions.get(c)
            signals.append(
                F.struct(
                    F.lit(c).alias("column_name"),
                    F.lit(d.name).alias("domain"),
                    F.lit(position).alias("position"),
                    F.lit(name_matches(d, c)).alias("by_name"),
                    F.lit(text_matches(d, told)).alias("by_text"),
                    F.lit(bool(told)).alias("has_text"),
                    F.lit(d.sample is not None).alias("has_pattern"),
                    F.count(c).alias("non_null"),
                    (
                        F.count_if(F.col(c).cast("string").rlike(d.sample)) if d.sample
                        else F.lit(0).cast("bigint")
                    ).alias("matching"),
                )
            )
    facts = facts_in_one_pass(df, signals)
    has_values = F.col("has_pattern") & (F.col("non_null") > 0)
    by_value = has_values & (F.col("matching") >= F.col("non_null") * VALUE_SHARE)

    def weight(condition, amount):
        return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))

    got = (
        weight(F.col("by_name"), NAME_WEIGHT)
        + weight(F.col("by_text"), TEXT_WEIGHT)
        + weight(by_value, VALUE_WEIGHT)
    )
    available = (
        F.lit(NAME_WEIGHT) + weight(F.col("has_text"), TEXT_WEIGHT) + weight(has_values, VALUE_WEIGHT)
    )
    why = F.concat_ws(
        "; ",
        F.when(F.col("by_name"), "name"),
        F.when(F.col("by_text"), "description"),
        F.when(by_value, F.concat(F.lit("values "), "matching", F.lit("/"), "non_null")),
    )
    scored = facts.select(
        "column_name", "domain", "position", F.round(got / available, 6).alias("score"), why.alias("why")
    ).filter("score > 0")
    # at most one entry per registered domain and column
    ranked = scored.groupBy("column_name").agg(
        F.reverse(
            F.array_sort(F.collect_list(F.struct("score", -F.col("position"), "domain", "why")))
        ).alias("r")
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    first, second = F.get("r", 0), F.get("r", 1)
    return names.join(ranked, "column_name", "left").select(
        "column_name",
        first["domain"].alias("domain"),
        F.coalesce(first["score"], F.lit(0.0)).alias("confidence"),
        second["domain"].alias("runner_up"),
        F.coalesce(second["score"], F.lit(0.0)).alias("runner_up_confidence"),
        F.coalesce(first["why"], F.lit("no signal")).alias("explanation"),
    )
