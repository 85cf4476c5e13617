"""The prefix trie against plain sets of prefixes, at container sizes that burst never, sometimes and always."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from tidewright.llm import conversation_trie, queries

SF = "/root/testdata/sf0.001"


def plain_rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    found = {}
    for c, ts in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = turns.get(c - c % 100, [])[:h] + ts[h:]
    return found


def plain_nodes(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids = defaultdict(int)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, held in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += (len(held) - 1) * len(path[-1][1]) if path else 0
    return sorted(
        ((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), kids[path], leaves[path], saved[path],
          hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()) for path, held in members.items()), key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def rows_of(df):
    return [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]


def test_query_over_the_whole_table(spark):
    rows = rows_of(spark.read.parquet(f"{SF}/conversations.parquet"))
    assert found(queries.op11_conversation_trie(spark, SF)) == plain_nodes(plain_rebuilt(rows))


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(1, 0, "user", "x"), (1, 1, "assistant", "é y"), (2, 0, "user", "x"), (2, 1, "assistant", "é y"), (2, 2, "user", None), (3, None, None, "x"),
            (3, 5, "user", "x"), (3, 5, "user", "x"), (None, 0, "user", "lost"), (4, 0, "", ""), (5, 0, "use", "rx"), (6, 7, "user", "long " * 60_000)]
    rows += [(100 + c, t, "user", f"shared {t}") for c in range(30) for t in range(c % 9)]
    rows += [(200 + c, t, "user", "again and again") for c in range(40) for t in range(8)]
    rows += [(200 + c, 8, "user", f"its own {c}") for c in range(0, 40, 4)]
    rows += [(700, t, "user", str(t)) for t in range(300)] + [(701, t, "user", str(t) if t < 290 else "other") for t in range(300)]
    return spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows],
                                 "conv_id long, turn long, role string, text string, turns string, ha string, n long").repartition(4)


@pytest.mark.parametrize("turns", [1, 40, 10**6])
@pytest.mark.parametrize("again", [False, True])
def test_hard_rows_at_every_container_size(hard, turns, again):
    convs = conversation_trie.conversations(hard)
    expected = plain_rebuilt(rows_of(hard))
    if not again:
        expected = {}
        for r in sorted(rows_of(hard), key=lambda r: (r[1] is not None, r[1] or 0)):
            if r[0] is not None:
                expected.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    nodes = conversation_trie.trie_nodes(conversation_trie.rebuilt(convs) if again else convs, container_turns=turns)
    assert found(nodes) == plain_nodes(expected)


def test_no_rows(hard):
    convs = conversation_trie.conversations(hard.filter("false"))
    nodes = conversation_trie.trie_nodes(conversation_trie.rebuilt(convs))
    assert nodes.count() == 0
    assert nodes.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def test_ids_of_a_node_are_digested_in_order_across_blocks(spark, monkeypatch):
    """One conversation many times: its ids come in several blocks from several ranges."""
    monkeypatch.setattr(conversation_trie, "BLOCK_IDS", 7)
    rows = spark.range(0, 300, 1, 9).selectExpr("id * 37 % 1000 as conv_id", "0L as turn", "'user' as role", "'same' as text")
    nodes = conversation_trie.trie_nodes(conversation_trie.conversations(rows))
    ids = {i * 37 % 1000: [("user", "same")] for i in range(300)}
    assert found(nodes) == plain_nodes(ids)
