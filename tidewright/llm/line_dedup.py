"""Site-relative line deduplication: lines on too large a share of a host's pages are boilerplate.

A line is a ``\\n``-separated piece, compared without the blanks around it. ``pages`` of a line are the
rows of its host that hold it at least once. A line goes, everywhere on its host, if its pages exceed
``ratio`` of the host's pages and are ``min_pages`` or more (tiny hosts have no boilerplate). With
``distinct_texts`` pages are the distinct whole texts of the host instead of its rows, so a group of exact
copies, which is deduplication's work, does not condemn its own lines.

Defined results: a null text stays null and has 0 lines, but its row counts as a page; a null host is
a host of its own; blank lines are never boilerplate and stay where they are; repeated rows count as
pages of their own; an empty table gives an empty table; other columns pass through, while columns
named ``n_lines`` and ``n_dropped`` are replaced.

Only 128-bit hashes of lines are shuffled and counted, with partial sums, so a host or line that holds
a third of all rows is no larger for any task. Boilerplate of a host is at most (mean distinct lines of a
page) / ``ratio`` lines whatever the size of the host, which bounds the list that is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import BLANKS, join_by_key, unused

RATIO = 0.1
MIN_PAGES = 5


def bare(line: Column) -> Column:
    """The line without ASCII blanks at its ends."""
    return F.regexp_replace(line, f"^{BLANKS}+|{BLANKS}+$", "")


def fingerprint(line: Column) -> Column:
    """Two hashes of different seeds: 128 bits of the bare line."""
    return F.struct(F.xxhash64(bare(line)).alias("a"), F.xxhash64(F.lit(7), bare(line)).alias("b"))


def boilerplate(docs: DataFrame, host: str, text: str, ratio: float, min_pages: int, distinct_texts: bool = False) -> DataFrame:
    """One row per host that has boilerplate: ``__host``, ``__flagged`` (fingerprints)."""
    distinct = F.array_distinct(
        F.transform(F.filter(F.split(text, "\n"), lambda x: bare(x) != ""), fingerprint)
    )
    pages = docs.select(F.col(host).alias("__host"), distinct.alias("__lines"), F.col(text).alias("__text"))
    if distinct_texts:
        whole = F.struct(F.col("__text").isNull(), F.xxhash64("__text"), F.xxhash64(F.lit(7), "__text"))
        pages = pages.groupBy("__host", whole.alias("__digest")).agg(F.first("__lines").alias("__lines"))
    totals = pages.groupBy("__host").agg(F.count(F.lit(1)).alias("__total"))
    lines = (
        pages.select("__host", F.explode("__lines").alias("__line"))
        .groupBy("__host", "__line")
        .agg(F.count(F.lit(1)).alias("__pages"))
        .filter(F.col("__pages") >= min_pages)
    )
    return (
        join_by_key(lines, totals, ["__host"], ["__line"], "inner")
        .filter(F.col("__pages") > ratio * F.col("__total"))
        .groupBy("__host")
        .agg(F.collect_list("__line").alias("__flagged"))
    )


def drop_boilerplate_lines(
    docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES,
    distinct_texts: bool = False,
) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``."""
    flagged = boilerplate(docs, host, text, ratio, min_pages, distinct_texts)
    spread = [c for c, kind in docs.dtypes if not kind.startswith(("map", "variant"))]
    bad, left = unused(docs.columns, "__flagged", "__kept")
    flagged = flagged.select(F.col("__host").alias(host), F.col("__flagged").alias(bad))
    joined = join_by_key(docs, flagged, [host], spread, "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(bad), fingerprint(x)))
    return (
        joined.withColumn(left, F.when(F.col(bad).isNull(), lines).otherwise(kept))
        .withColumn("n_lines", F.coalesce(F.when(F.col(text).isNotNull(), F.size(lines)), F.lit(0)).cast("long"))
        .withColumn("n_dropped", (F.col("n_lines") - F.coalesce(F.when(F.col(text).isNotNull(), F.size(left)), F.lit(0))).cast("long"))
        .withColumn(text, F.array_join(left, "\n"))
        .drop(left, bad)
    )


QUERY_SQL = rf"""
with pieces as (
  select doc_id, source, text, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as place
  from documents),
bared as (
  select *, regexp_replace(line, '^{BLANKS}+|{BLANKS}+$', '', 'g') as key from pieces),
totals as (select source, count(*) as total from documents group by source),
counts as (select source, key, count(distinct doc_id) as pages from bared where key <> '' group by source, key),
bad as (
  select c.source, c.key from counts c join totals t on c.source is not distinct from t.source
  where c.pages >= {MIN_PAGES} and c.pages > {RATIO} * t.total),
marked as (
  select b.*, bad.key is not null as dropped
  from bared b left join bad on b.source is not distinct from bad.source and b.key = bad.key),
joined as (
  select doc_id, count(*) as n_lines, sum(dropped::int)::bigint as n_dropped,
         coalesce(string_agg(line, chr(10) order by place) filter (where not dropped), '') as kept
  from marked group by doc_id)
select d.doc_id, d.source, coalesce(j.n_lines, 0) as n_lines, coalesce(j.n_dropped, 0) as n_dropped,
       case when d.text is not null then j.kept end as text
from documents d left join joined j on d.doc_id = j.doc_id"""
