"""Conversation prefix trie by burst tries: containers of suffixes under trie heads, bursting by the next turn id.

A turn's id is a 128-bit digest of role and text; a conversation is its row of turn ids and lengths, without texts. Equal
conversations are one weighted row, counted before they are shuffled, so a conversation repeated any number of times is
one suffix.

1. Bursting. A container holds the suffixes below one head (a prefix); all start in the root's. A container of two or more
   suffixes that weigh over ``container_turns`` turns bursts: the turns that all of it share become a chain of nodes
   below the head (the shared length of its least and greatest suffix), and the others move to containers of their own
   under the chain's end, by their next turn id. A round bursts all such containers at once; they end when none is left.
2. Sweeping. The remaining containers are dealt over tasks, sorted, and swept with a stack: a node per distinct prefix,
   with its members, leaves and savings. A task holds one container, or one longer conversation.
3. Folding. Containers' tops are summed into the chains above them, from the last round to the first.

Digests of the conversations that end at a node run over ids in order, which one node's task must do in sequence; the ids
come to it sorted and joined to texts of up to ``BLOCK_IDS`` by tasks that share them by range, and it streams them.

Defined results: null role or text is empty; rows of a conversation are ordered by turn, null first, equal turns by their
digest; repeated rows are turns of their own; rows without conv_id belong to no conversation and take no part; a
conversation without turns is a member of the root alone; no conversations, no nodes; other columns do not pass. A
conversation's ids are held as a whole (24 bytes a turn), its texts never. Every round is written to the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import Scratch, join_by_key

CONTAINER_TURNS = 4096
BLOCK_IDS = 8192
HEADS = 6
#: prefix conversations of rebuilt ones stand at whole hundreds
SHARE = 100
HEAD = ["ha", "hb"]
KEY = ["ka", "kb"]
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turns: one row per conversation with its turns' digests (a, b) and code points (n), in order."""
    said_by, said = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    named = rows.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.struct(F.col(turn).alias("turn"), F.xxhash64(said_by, said).alias("a"), F.xxhash64(F.lit("turn"), said, said_by).alias("b"),
                 F.length(said).cast("long").alias("n")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return named.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["a"], t["b"], t["n"])).alias("turns"))


def rebuilt(convs: DataFrame) -> DataFrame:
    """Every conversation c behind the first h turns of conversation c - c % 100; h = crc32(decimal c) % 6 of its own go."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    heads = convs.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("lent"))
    heads = heads.filter(F.col("base") % SHARE == 0)
    own = F.slice(F.col("turns"), h + 1, F.greatest(F.size("turns"), F.lit(1)))
    lent = F.when(F.col("lent").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("lent", F.lit(1), h))
    joined = convs.join(heads, F.col("conv_id") - F.col("conv_id") % SHARE == F.col("base"), "left")
    return joined.select("conv_id", F.concat(lent, own).alias("turns"))


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (ka, kb, conv_id) to (ka, kb, least id, ids joined by commas), runs of one key cut at ``BLOCK_IDS``."""
    for batch in batches:
        ka, kb, ids = (c.to_numpy() for c in batch.columns)
        if not len(ids):
            continue
        cuts = np.flatnonzero((ka[1:] != ka[:-1]) | (kb[1:] != kb[:-1])) + 1
        edges = sorted({0, *cuts.tolist(), *range(0, len(ids), BLOCK_IDS), len(ids)})
        first = np.array(edges[:-1])
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(ka[first]), pa.array(kb[first]), pa.array(ids[first]), pa.array(texts)],
                                         names=["ka", "kb", "least", "ids"])


def _id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by key and least id to (ka, kb, ends_sha256)."""
    key, state = None, None
    for batch in batches:
        done = []
        for a, b, ids in zip(*(batch.column(c).to_pylist() for c in ("ka", "kb", "ids")), strict=True):
            if (a, b) == key:
                state.update(b"," + ids.encode())
                continue
            if key is not None:
                done.append((*key, state.hexdigest()))
            key, state = (a, b), hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=["ka", "kb", "ends_sha256"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, state.hexdigest())], names=["ka", "kb", "ends_sha256"])


def swept(suffixes: list[tuple[list, list, int, int, str]], depth: int) -> list[list]:
    """Nodes of one container from its sorted suffixes (turn ids, lengths, members, least member, digest of the ends).

    ``depth`` is the head's; suffixes begin with the head's last turn (length 0 at the root). A node is
    [least member, depth, parent's place, members, children, leaves, savings, digest, length].
    """
    nodes: list[list] = []
    path: list[int] = []
    before: list = []

    def close(down_to: int) -> None:
        while len(path) > down_to:
            node = nodes[path.pop()]
            node[5] = node[5] or 1
            node[6] += (node[3] - 1) * node[8]
            if path:
                above = nodes[path[-1]]
                above[0] = min(above[0], node[0])
                above[3] += node[3]
                above[4] += 1
                above[5] += node[5]
                above[6] += node[6]

    for ids, lengths, members, least, ends in suffixes:
        shared, most = 0, min(len(before), len(ids))
        while shared < most and before[shared] == ids[shared]:
            shared += 1
        close(shared)
        for place in range(len(path), len(ids)):
            nodes.append([least, depth + place, path[-1] if path else -1, 0, 0, 0, 0, NOTHING, lengths[place]])
            path.append(len(nodes) - 1)
        node = nodes[path[-1]]
        node[0], node[3], node[7] = min(node[0], least), node[3] + members, ends
        before = ids
    close(0)
    return nodes


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffixes sorted by container to the nodes of every container; a container's top names it and its parent."""
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top", "ha", "hb", "pa", "pb"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.bool_(), *[pa.int64()] * 4]
    out: list[tuple] = []
    head, held = None, []

    def finish() -> None:
        nodes = swept(held, head[4])
        for n in nodes:
            out.append((n[0], n[1], nodes[n[2]][0] if n[2] >= 0 else None, *n[3:8], n[2] < 0, *head[:4]))

    def written() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=names)

    for batch in batches:
        for ha, hb, up_a, up_b, depth, a, b, n, members, least, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (ha, hb, up_a, up_b, depth) != head:
                if head is not None:
                    finish()
                if len(out) >= 10_000:
                    yield written()
                head, held = (ha, hb, up_a, up_b, depth), []
            held.append((list(zip(a, b, strict=True)), n, members, least, ends))
    if head is not None:
        finish()
    if out:
        yield written()


def _digest_of(parts: list[Column], salt: str) -> Column:
    return F.xxhash64(F.lit(salt), *parts)


def trie_nodes(convs: DataFrame, container_turns: int = CONTAINER_TURNS) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row per distinct prefix."""
    spark = convs.sparkSession
    scratch = Scratch(spark)
    keyed = convs.select("conv_id", "turns", _digest_of([F.col("turns")], "a").alias("ka"), _digest_of([F.col("turns")], "b").alias("kb"))
    keyed = scratch.stored(keyed, "trie-conversations")
    blocks = keyed.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    blocks = blocks.mapInArrow(_id_blocks, "ka long, kb long, least long, ids string")
    ends = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "least").mapInArrow(_id_digests, "ka long, kb long, ends_sha256 string")
    groups = keyed.groupBy(*KEY, "turns").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).join(ends, KEY)
    none = F.lit(None).cast("long")
    members = groups.select("turns", "n", "least", "ends_sha256", F.lit(0).cast("long").alias("ha"), F.lit(0).cast("long").alias("hb"),
                            none.alias("pa"), none.alias("pb"), F.lit(0).alias("depth"))
    members = scratch.stored(members, "trie-members-0")

    settled, bursts = [], []
    while True:
        sizes = members.groupBy(*HEAD).agg(F.sum(F.size("turns") - F.col("depth") + 1).alias("weight"), F.count(F.lit(1)).alias("suffixes"))
        large = scratch.stored(sizes.filter((F.col("weight") > container_turns) & (F.col("suffixes") > 1)).select(*HEAD, F.lit(True).alias("large")),
                               "trie-large")
        if large.isEmpty():
            settled.append(members)
            break
        marked = scratch.stored(join_by_key(members, large, HEAD, ["least"]), "trie-marked")
        settled.append(marked.filter("large is null").drop("large"))
        burst = marked.filter("large").drop("large")
        # the least and the greatest suffix share what all of them share
        paths = burst.groupBy(*HEAD, "pa", "pb", "depth").agg(F.min("turns").alias("low"), F.max("turns").alias("high"))
        shared = F.array_position(F.zip_with("low", "high", lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1
        path = paths.withColumn("branch", shared.cast("int"))
        lengths = F.transform(F.slice("low", F.greatest(F.col("depth"), F.lit(1)), F.col("branch") - F.greatest(F.col("depth"), F.lit(1)) + 1), lambda t: t["n"])
        lengths = F.when(F.col("depth") == 0, F.concat(F.array(F.lit(0).cast("long")), lengths)).otherwise(lengths)
        paths = scratch.stored(path.select(*HEAD, "pa", "pb", "depth", "branch", lengths.alias("lengths")), "trie-paths")
        moved = join_by_key(burst, paths.select(*HEAD, "branch"), HEAD, ["least"], "inner")
        ended = scratch.stored(moved.filter(F.size("turns") == F.col("branch")).select(*HEAD, "n", "least", "ends_sha256"), "trie-ended")
        bursts.append((paths, ended))
        below = [F.slice("turns", F.col("depth") + 1, F.col("branch") - F.col("depth") + 1)]
        members = moved.filter(F.size("turns") > F.col("branch")).select(
            "turns", "n", "least", "ends_sha256", _digest_of([F.col("ha"), *below], "a").alias("ha"), _digest_of([F.col("hb"), *below], "b").alias("hb"),
            F.col("ha").alias("pa"), F.col("hb").alias("pb"), (F.col("branch") + 1).alias("depth"))
        members = scratch.stored(members, f"trie-members-{len(bursts)}")

    containers = reduce(DataFrame.unionByName, settled)
    part = lambda name: F.transform("turns", lambda t: t[name])
    # a suffix begins with the head's last turn; the root, which has none, gets an empty one
    start = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"))
    suffix = F.when(F.col("depth") == 0, F.concat(F.array(start), F.col("turns")))
    suffix = suffix.otherwise(F.slice("turns", F.greatest(F.col("depth"), F.lit(1)), F.greatest(F.size("turns"), F.lit(1))))
    containers = containers.withColumn("turns", suffix).repartition(*HEAD).sortWithinPartitions(*HEAD, "turns")
    containers = containers.select(*HEAD, "pa", "pb", F.col("depth").cast("long"), part("a").alias("ids_a"), part("b").alias("ids_b"), part("n").alias("lengths"), "n", "least", "ends_sha256")
    nodes = scratch.stored(containers.mapInArrow(_sweep, f"{NODE}, top boolean, ha long, hb long, pa long, pb long"), "trie-nodes")

    tops = nodes.filter("top").select("pa", "pb", "n_convs", "conv_id", "n_leaves", "saved_tokens")
    chains = []
    for paths, ended in reversed(bursts):
        kids = tops.select(F.col("pa").alias("ha"), F.col("pb").alias("hb"), "n_convs", "conv_id", "n_leaves", "saved_tokens",
                           F.lit(1).alias("child"), F.lit(None).cast("string").alias("ends_sha256"))
        here = ended.select(*HEAD, F.col("n").alias("n_convs"), F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("n_leaves"),
                            F.lit(0).cast("long").alias("saved_tokens"), F.lit(0).alias("child"), "ends_sha256")
        sums = kids.unionByName(here).groupBy(*HEAD).agg(
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved_tokens").alias("below"), F.sum("child").alias("n_children"), F.max("ends_sha256").alias("ends_sha256"))
        chain = scratch.stored(paths.join(sums, HEAD), "trie-chains")
        chains.append(chain)
        whole = F.aggregate("lengths", F.lit(0).cast("long"), lambda x, y: x + y)
        tops = tops.unionByName(chain.select("pa", "pb", "n_convs", "conv_id", "n_leaves", (F.col("below") + (F.col("n_convs") - 1) * whole).alias("saved_tokens")))

    plain = nodes.filter("not top or depth = 0").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    if not chains:
        return plain
    heads = reduce(DataFrame.unionByName, chains)
    links = heads.select(*[F.col(c) for c in HEAD], "pa", "pb", "depth", "branch", "n_convs", "conv_id", "n_leaves", "n_children", "below", "ends_sha256",
                         F.posexplode("lengths").alias("place", "length"))
    upward = Window.partitionBy(*HEAD).orderBy(F.col("place").desc())
    last = F.col("depth") + F.col("place") == F.col("branch")
    links = links.select(
        "conv_id", (F.col("depth") + F.col("place")).cast("long").alias("depth"), F.when(F.col("place") > 0, F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(last, F.col("n_children")).otherwise(F.lit(1)).cast("long").alias("n_children"), "n_leaves",
        (F.col("below") + (F.col("n_convs") - 1) * F.sum("length").over(upward)).alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
        (F.col("place") == 0).alias("top"), "pa", "pb")
    # tops below a chain take the parent's name from it
    tops = nodes.filter("top and depth > 0").drop(*HEAD).unionByName(links.filter("top and depth > 0"))
    parents = heads.select(F.col("ha").alias("pa"), F.col("hb").alias("pb"), F.col("conv_id").alias("named"))
    tops = join_by_key(tops, parents, ["pa", "pb"], ["conv_id"], "inner").withColumn("parent_conv_id", F.col("named"))
    return plain.unionByName(tops.select(*plain.columns)).unionByName(links.filter("not top or depth = 0").select(*plain.columns))


_STEP = "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], (x, y) -> xor(x // 2, 3988292384 * (x % 2)))"
#: DuckDB twin of the query; the CRC is computed bit by bit
QUERY_SQL = f"""
with ordered as (
  select conv_id, list(struct_pack(role := coalesce(role, ''), txt := coalesce(text, '')) order by turn nulls first) as turns
  from conversations where conv_id is not null group by conv_id),
cut as (
  select *, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), d -> ascii(d)::bigint)),
                            (crc, byte) -> {_STEP}), 4294967295::bigint) % {HEADS} as h
  from ordered),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) as turns
  from cut c left join ordered b on b.conv_id = c.conv_id - c.conv_id % {SHARE}),
named as (
  select conv_id, list_transform(turns, t -> md5(t.role || chr(1) || t.txt)) as ids, list_transform(turns, t -> length(t.txt)) as sizes from rebuilt),
prefixes as (
  select conv_id, d as depth, ids[1:d] as path, len(ids) = d as ends, case when d = 0 then 0 else sizes[d] end as size
  from (select *, unnest(range(0, len(ids) + 1)) as d from named)),
nodes as (
  select path, depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(size) as size,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256
  from prefixes group by path, depth),
kids as (select path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1),
counted as (select n.*, coalesce(k.n_children, 0) as n_children from nodes n left join kids k using (path)),
spread as (select *, unnest(range(0, depth + 1)) as d from counted),
sums as (
  select path[1:d] as path, sum((n_children = 0)::int)::bigint as n_leaves, sum((n_convs - 1) * size)::bigint as saved_tokens from spread group by 1)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, s.n_leaves, s.saved_tokens, c.ends_sha256
from counted c join sums s using (path) left join nodes p on c.depth > 0 and p.path = c.path[1:c.depth - 1]"""
