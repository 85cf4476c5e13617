"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and share ``share`` times
   all words; a target stops at ``most`` times its source's size and the excess is shared again by weight.
   The capped sources are a prefix of the sources ordered by cap / weight, so two running sums find them.
2. Quotas: round(all targets / block_words) blocks go to sources by highest quotients
   target / (2k + 1), and a source's blocks go to its shards in the same way by shard size. Only
   quotients near the threshold are ranked (at most about two per contender), however many blocks there are.
3. Selection: a shard's documents stand in seeded order on a line of words that is cut into blocks.
   Quota div blocks whole passes are taken, and of the rest a seeded, evenly spaced choice of exactly
   (quota mod blocks) blocks; a document takes the words of its part of the line.

``take_documents`` fills the same quotas with whole documents: quota div shard size whole passes, then documents from
the start of the line as long as their middle lies within the words still due. A shard misses its quota by at most half
of the document on the edge; a shard whose first document is more than twice the words due takes none.

Defined results: a null text has size 0; sources of size 0 have target 0; an empty table gives an empty
table; repeated rows are rows of their own; ties of the seeded order end with id and size. The same rows
give the same result in any partitioning. Columns of the input other than the three read do not pass.

Everything is DataFrame functions. Shards hold about ``shard_rows`` documents, so the running sum of a
source that holds a third of all rows is spread over many tasks; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import WORD, join_by_key, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 64
SHARD_ROWS = 4096
SEED = "mix-1"


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, n_rows, place, weight, target."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("place", place).withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    )
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = (
        per.withColumn("all_words", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("left_words", F.col("all_words") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("left_weight", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left_words") / F.col("left_weight"))
        .withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    )
    # the first source that is not capped has the largest weight still left
    free = F.max(F.when(~F.col("capped"), F.struct("left_weight", "level"))).over(whole)
    return per.withColumn("free", free["level"]).select(
        "source", "source_size", "n_rows", "place", "weight",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("free")).alias("target"),
    )


def highest_quotients(rows: DataFrame, group: list[str], order: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: give each group's ``seats`` to its rows by the highest votes / (2k + 1).

    With n contenders, the divisors votes / (seats - n/2) and votes / (seats + n/2) give too few and too
    many seats, so only seats between the two roundings are ranked; ties go by ``order``.
    """
    whole = Window.partitionBy(*group)
    n, total = F.count(F.lit(1)).over(whole), F.sum(votes).over(whole)
    few, many = F.col(seats) - n / 2, F.col(seats) + n / 2
    share = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    bounded = rows.withColumn("__low", F.greatest(F.lit(0), F.floor(share * few + 0.5) - 1).cast("long")).withColumn(
        "__high", F.greatest(F.lit(0), F.floor(share * many + 0.5) + 1).cast("long")
    )
    contested = bounded.withColumn("__open", F.col(seats) - F.sum("__low").over(whole)).withColumn(
        "__seat", F.explode(F.sequence(F.col("__low") + 1, F.greatest(F.col("__high"), F.col("__low") + 1)))
    )
    quotient = F.col(votes) / (2 * F.col("__seat") - 1)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(quotient.desc(), *order, "__seat"))
    won = (F.col("__rank") <= F.col("__open")) & (F.col(votes) > 0)
    return (
        contested.withColumn("__rank", rank)
        .groupBy(*rows.columns)
        .agg((F.first("__low") + F.sum(F.when(won, 1).otherwise(0))).alias("__won"))
        .select(*rows.columns, F.col("__won").cast("long").alias(out))
    )


def seeded(seed: str, *parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))


def number(digest: Column) -> Column:
    """The first 32 bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def words_before(at: Column, block_words: int) -> Column:
    """Words that a shard's choice takes of the first ``at`` words of its line."""
    block = F.floor(at / block_words).cast("long")
    chosen = lambda b: F.floor((b * F.col("__rest") + F.col("__start")) / F.col("__blocks")).cast("long")
    part = (chosen(block + 1) - chosen(block)) * (at - block * block_words)
    return F.col("__passes") * at + chosen(block) * block_words + part


def placed_documents(
    docs: DataFrame, doc_id: str, source: str, text: str, weights, share: float, most: int, block_words: int, shard_rows: int, seed: str,
) -> DataFrame:
    """Every document with its place on the line of its shard, the shard's words, blocks and quota of blocks."""
    sizes = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    targets = source_targets(sizes, weights, share, most)
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")
    quotas = highest_quotients(targets.withColumn("blocks", blocks), [], ["place"], "target", "blocks", "quota")
    shards = F.ceil(F.col("n_rows") / shard_rows)
    dealt = (
        join_by_key(sizes, quotas, ["source"], ["doc_id", "size"], "inner")
        .withColumn("digest", seeded(seed, F.col("doc_id")))
        .withColumn("shard", F.pmod(number(F.col("digest")), shards).cast("int"))
    )
    held = dealt.groupBy("place", "quota", "shard").agg(F.sum("size").alias("shard_size"))
    held = highest_quotients(held, ["place"], ["shard"], "shard_size", "quota", "shard_quota")
    n = F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1)).cast("long")
    held = held.select(F.col("place").alias("__p"), F.col("shard").alias("__sh"), F.col("shard_size").alias("__words"), n.alias("__blocks"),
                       F.least(F.col("shard_quota"), most * n).alias("__quota"))
    line = Window.partitionBy("place", "shard").orderBy("digest", "doc_id", "size")
    placed = dealt.withColumn("__end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return placed.join(held, (F.col("place") == F.col("__p")) & (F.col("shard") == F.col("__sh")))


def mix_sources(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
    share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: what the mix takes of each document, in words."""
    placed = placed_documents(docs, doc_id, source, text, weights, share, most, block_words, shard_rows, seed)
    placed = (
        placed.withColumn("__passes", F.floor(F.col("__quota") / F.col("__blocks")).cast("long"))
        .withColumn("__rest", F.col("__quota") - F.col("__passes") * F.col("__blocks"))
        .withColumn("__start", F.pmod(number(seeded(seed, F.col("place"), F.col("shard"))), F.col("__blocks")))
    )
    taken = words_before(F.col("__end"), block_words) - words_before(F.col("__end") - F.col("size"), block_words)
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def take_documents(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS,
    share: float = SHARE, most: int = MOST, block_words: int = BLOCK_WORDS, shard_rows: int = SHARD_ROWS, seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, times: how often the mix takes each document as a whole."""
    placed = placed_documents(docs, doc_id, source, text, weights, share, most, block_words, shard_rows, seed)
    placed = placed.withColumn("__due", F.least(F.col("__quota") * block_words, most * F.col("__words")))
    passes = F.floor(F.col("__due") / F.col("__words")).cast("long")
    rest = F.col("__due") - passes * F.col("__words")
    times = passes + (2 * F.col("__end") - F.col("size") <= 2 * rest).cast("long")
    times = F.when(F.col("size") > 0, times).otherwise(F.lit(0))
    return placed.select("doc_id", "source", "size", "source_size", "target", times.cast("int").alias("times"))


def _quotient_sql(rows: str, group: str, order: str, votes: str, seats: str, out: str) -> str:
    """DuckDB twin of highest_quotients over the relation ``rows`` whose key is (group, order)."""
    part = f"partition by {group}" if group else ""
    return f"""(
  with base as (select *, count(*) over ({part}) as n__, sum({votes}) over ({part}) as t__ from {rows}),
  bounded as (select *, greatest(0, floor(coalesce({votes} / nullif(t__, 0), 0.0) * ({seats} - n__ / 2.0) + 0.5) - 1)::bigint as low__,
    greatest(0, floor(coalesce({votes} / nullif(t__, 0), 0.0) * ({seats} + n__ / 2.0) + 0.5) + 1)::bigint as high__ from base),
  contested as (select *, {seats} - sum(low__) over ({part}) as open__ from bounded),
  each_seat as (select *, unnest(range(low__ + 1, greatest(high__, low__ + 1) + 1)) as seat__ from contested),
  ranked as (select *, row_number() over ({part} order by {votes}::double / (2 * seat__ - 1) desc, {order}, seat__) as rank__ from each_seat)
  select {group + ',' if group else ''} {order}, (min(low__) + sum((rank__ <= open__ and {votes} > 0)::int))::bigint as {out}
  from ranked group by {group + ',' if group else ''} {order})"""


def query_sql() -> str:
    taken = f"""(q.passes * {{at}} + ((({{at}} // {BLOCK_WORDS}) * rest + start) // blocks) * {BLOCK_WORDS}
      + (((({{at}} // {BLOCK_WORDS}) + 1) * rest + start) // blocks - (({{at}} // {BLOCK_WORDS}) * rest + start) // blocks)
        * ({{at}} - ({{at}} // {BLOCK_WORDS}) * {BLOCK_WORDS}))"""
    weights = "[" + ", ".join(f"{w}.0::double" for w in WEIGHTS) + "]"
    return f"""
with sizes as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
per as (
  select source, sum(size)::bigint as source_size, count(*) as n_rows,
         row_number() over (order by encode(source) nulls last) - 1 as place
  from sizes group by source),
weighted as (select *, {weights}[place % {len(WEIGHTS)} + 1] as weight, {float(MOST)}::double * source_size as cap from per),
levels as (
  select *, (sum(source_size) over () * {SHARE}::double
             - coalesce(sum(cap) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0))
         / (sum(weight) over ()
             - coalesce(sum(weight) over (order by cap / weight, place rows between unbounded preceding and 1 preceding), 0)) as level
  from weighted),
free as (select arg_max(level, weight_left) as level from (
  select level, sum(weight) over (order by cap / weight desc, place desc) as weight_left, cap / weight <= level as capped
  from levels) where not capped),
targets as (
  select place, source, source_size, n_rows, case when cap / weight <= l.level then cap else weight * f.level end as target
  from levels l left join free f on true),
budget as (select *, round(sum(target) over () / {BLOCK_WORDS})::bigint as blocks_all from targets),
quotas as (select * from {_quotient_sql('budget', '', 'place', 'target', 'blocks_all', 'quota')}),
dealt as (
  select s.doc_id, s.source, s.size, t.source_size, t.target, t.place, q.quota,
         md5('{SEED}:' || coalesce(s.doc_id::varchar, 'null')) as digest, t.n_rows
  from sizes s join targets t on s.source is not distinct from t.source join quotas q on q.place = t.place),
sharded as (
  select *, ('0x' || substr(digest, 1, 8))::bigint % ceil(n_rows / {SHARD_ROWS}.0)::bigint as shard from dealt),
held as (select place, quota, shard, sum(size)::bigint as shard_size from sharded group by place, quota, shard),
shard_quotas as (select * from {_quotient_sql('held', 'place', 'shard', 'shard_size', 'quota', 'shard_quota')}),
passes as (
  select h.place, h.shard, greatest(ceil(h.shard_size / {BLOCK_WORDS}.0), 1)::bigint as blocks,
         least(s.shard_quota, {MOST} * greatest(ceil(h.shard_size / {BLOCK_WORDS}.0), 1))::bigint as quota,
         ('0x' || substr(md5('{SEED}:' || h.place || ':' || h.shard), 1, 8))::bigint as draw
  from held h join shard_quotas s on h.place = s.place and h.shard = s.shard),
q as (
  select s.*, sum(s.size) over (partition by s.place, s.shard order by digest, doc_id, size rows unbounded preceding)::bigint as ends,
         p.blocks, p.quota // p.blocks as passes, p.quota % p.blocks as rest, p.draw % p.blocks as start
  from sharded s join passes p on s.place = p.place and s.shard = p.shard)
select doc_id, source, size, source_size, target,
       ({taken.format(at='ends')} - {taken.format(at='(ends - size)')})::bigint as taken
from q"""
