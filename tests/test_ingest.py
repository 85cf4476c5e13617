import itertools
import re

import pytest
from pyspark.sql import functions as F

from tidewright.operators import ranking
from tidewright.operators.ranking import latest, merge_winners
from tidewright.plans.ingest import (
    apply_batches,
    snapshot_latest,
    typed_batch,
    upsert_last_batch,
    upsert_newest,
)
from tidewright.specs import ColumnSpec, TableDef

CLAIMS = TableDef(
    "claims",
    (
        ColumnSpec("claim_id"),
        ColumnSpec("claim_amount", "DECIMAL", precision=18, scale=2),
        ColumnSpec("service_date", "DATE", format="YYYYMMDD"),
    ),
    primary_key=("claim_id",),
    mode="incremental",
)
RAW = "claim_id string, claim_amount string, service_date string, _load_ts string"


def batch(spark, data):
    return typed_batch(spark.createDataFrame(data, RAW), CLAIMS)


def test_incremental_claims(spark, rows):
    first = batch(
        spark,
        [
            ("C1", "$100.00", "20240101", "2024-01-01 08:00:00"),
            ("C1", "$150.00", "20240101", "2024-01-01 09:00:00"),
            ("C2", "$200.00", "20240102", "2024-01-01 08:00:00"),
            ("C3", "bad", "20240103", "2024-01-01 08:00:00"),
        ],
    )
    second = batch(
        spark,
        [
            ("C1", "$170.00", "20240101", "2024-01-02 08:00:00"),
            ("C1", "$180.00", "20240101", "2024-01-02 09:00:00"),
            ("C2", "$225.00", "20240102", "2024-01-02 08:00:00"),
            ("C4", "$300.00", "20240104", "2024-01-02 08:00:00"),
        ],
    )
    assert first.columns == ["claim_id", "claim_amount", "service_date"]
    out = upsert_last_batch(first, second, ["claim_id"])
    assert rows(out, "claim_id", "claim_amount") == [
        ("C1", "180.00"), ("C2", "225.00"), ("C3", None), ("C4", "300.00")
    ]
    # applying the same batch again changes nothing
    assert rows(upsert_last_batch(out, second, ["claim_id"])) == rows(out)


def entities(spark, *data):
    return spark.createDataFrame(list(data), "k string, revision int, at string")


def test_two_upsert_guards(spark, rows):
    batches = [
        entities(spark, ("K1", 1, "08:00"), ("K1", 2, "09:00"), ("K2", 5, "09:00")),
        entities(spark, ("K2", 9, "07:00")),
        entities(spark, ("K3", 1, "06:00")),
    ]
    last = apply_batches([latest(b, ["k"], ["at"]) for b in batches], ["k"], ["at"])
    assert rows(last, "k", "revision") == [("K1", "2"), ("K2", "9"), ("K3", "1")]
    results = set()
    for order in itertools.permutations(batches):
        out = order[0]
        for b in order[1:]:
            out = upsert_newest(out, b, ["k"], ["at"])
        results.add(tuple(rows(latest(out, ["k"], ["at"]), "k", "revision")))
    assert results == {(("K1", "2"), ("K2", "5"), ("K3", "1"))}
    with pytest.raises(ValueError, match="guard"):
        apply_batches(batches, ["k"], ["at"], guard="other")


def test_dedup_is_idempotent_and_total(spark, rows):
    df = spark.createDataFrame([("a", 1, x) for x in "qwerty"], "k string, at int, v string")
    once = latest(df, ["k"], ["at"])
    again = latest(df.repartition(5).unionByName(once), ["k"], ["at"])
    assert rows(once) == rows(again) and once.count() == 1


def test_snapshot_keeps_newest_delivery(spark, rows):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "k string, at int")
    assert rows(snapshot_latest(df, "at"), "k") == [("b",), ("c",)]


def test_merge_prefers_score_then_source(spark, rows):
    df = spark.createDataFrame(
        [("k", 0, 0, "2024-01-01"), ("k", 1, 1, "2024-02-01"), ("j", 0, 2, None), ("j", 1, 3, None),
         (None, 1, 4, "2024-01-01")],
        "k string, src int, n int, t string",
    )
    won = merge_winners(df, ["k"], {"t": F.col("t").cast("date")}, "src", "n", audit=True)
    assert rows(won, "k", "n", "merge_score") == [
        ("j", "2", "0"), ("k", "1", "1"), (None, "4", "1")
    ]


def test_all_blank_and_all_garbage_rows_stay(spark, rows):
    out = batch(spark, [("B", "", "", "1"), ("G", "x", "y", "1")])
    assert rows(out) == [("B", None, None), ("G", None, None)]


@pytest.mark.parametrize("subsets", [4, 2])
def test_merge_matches_brute_force(spark, monkeypatch, subsets):
    """Several timestamps, many ties, one key with a third of the rows; by subsets, and by salted maxima."""
    monkeypatch.setattr(ranking, "SUBSETS_UP_TO", subsets)
    data = [
        ("hot" if i % 3 == 0 else f"k{i % 7}", i % 4, i, (i * 7) % 5, None if i % 11 == 0 else (i * 3) % 4,
         (i * i) % 6)
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "k string, src int, n int, a int, b int, c int")
    stamps = {name: F.col(name) for name in "abc"}
    won = merge_winners(df, ["k"], stamps, "src", "n", audit=True)
    want = {}
    for key in {d[0] for d in data}:
        mine = [d for d in data if d[0] == key]
        tops = [max((d[j] for d in mine if d[j] is not None), default=None) for j in (3, 4, 5)]
        ranked = [
            (-sum(d[j] is not None and d[j] == t for j, t in zip((3, 4, 5), tops)), d[1], d[2]) for d in mine
        ]
        want[key] = min(ranked)
    assert {r.k: (-r.merge_score, r.src, r.n) for r in won.collect()} == want
    plan = won._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Window" not in plan and "partial_max" in plan
    # rows meet their key's facts by (key, source, row), or by (key, salt): a hot key is many join keys
    joins = re.findall(r"Join \[(.*?)\], \[", plan)
    assert len(joins) == (1 if subsets == 4 else 2) and all("src" in j or "pmod(xxhash64" in j for j in joins)


def test_last_batch_is_one_ranking(spark, rows):
    """Older and newer rows alike go, all rows of a key in the batch come, rows without a whole key stay."""
    target = spark.createDataFrame([("a", 1, 9), ("a", 1, 8), ("b", 1, 7), (None, 1, 6), ("c", None, 5)], "k string, l int, v int")
    batch = spark.createDataFrame([("a", 1, 1), ("a", 1, 2), (None, 1, 3), ("d", 1, 4)], "k string, l int, v int")
    out = upsert_last_batch(target, batch, ["k", "l"])
    assert rows(out, "v") == [(str(v),) for v in (1, 2, 3, 4, 5, 6, 7)]
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Partial" in plan
