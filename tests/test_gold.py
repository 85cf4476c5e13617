import pytest
from pyspark.sql import functions as F

from tidewright.operators import survivorship as sv
from tidewright.operators.aggregates import Measure
from tidewright.operators.filters import exclude_matching, flag_matching, since
from tidewright.operators.joins import enrich, first_record, fk_coverage, orphans
from tidewright.operators.project import map_values, null_literals, override
from tidewright.operators.reshape import pivot_ranked, unpivot_columns, unpivot_latest
from tidewright.operators.sets import key_universe
from tidewright.plans.derive import Joined, Newest, Summarised, derive
from tidewright.queries import joining, load_all
from tidewright.specs import ColumnSpec, TableDef


def test_left_join_keeps_orphans(spark, rows):
    claims = spark.createDataFrame([(101, 1), (104, 9)], "claim_id int, member_id int")
    member = spark.createDataFrame([(1, "Ann")], "member_id int, member_name string")
    out = enrich(claims, member, {"member_id": "member_id"}, "m", ["member_name"])
    assert rows(out, "claim_id", "m__member_name") == [("101", "Ann"), ("104", None)]
    assert orphans(claims, member, {"member_id": "member_id"}).count() == 1
    facts = fk_coverage(claims, member, {"member_id": "member_id"}).first()
    assert tuple(facts) == (2, 1, 1, 0.5)


def test_inner_join_with_filter(spark, rows):
    claims = spark.createDataFrame([(i, i % 4) for i in range(100, 105)], "claim_id int, member_id int")
    member = spark.createDataFrame(
        [(0, "PPO", "West"), (1, "HMO", "West"), (2, "PPO", "no region here"), (3, "PPO", None)],
        "member_id int, plan_type string, region string",
    )
    out = enrich(
        claims, member, {"member_id": "member_id"}, "m", [], "inner",
        "plan_type = 'PPO' AND coalesce(upper(region), '') <> 'NO REGION HERE'",
    )
    assert rows(out, "claim_id") == [("100",), ("103",), ("104",)]


def test_first_record_is_total(spark, rows):
    hub = spark.createDataFrame([(1,), (2,), (3,)], "parent_id int")
    detail = spark.createDataFrame(
        [(1, "b", "beta"), (1, "a", "alpha"), (2, "c", "gamma")],
        "parent_id int, record_type string, detail_value string",
    )
    out = first_record(hub, detail, {"parent_id": "parent_id"}, "d", ["detail_value"])
    assert rows(out) == [("1", "alpha"), ("2", "gamma"), ("3", None)]
    newest = first_record(
        hub, detail, {"parent_id": "parent_id"}, "d", ["detail_value"], ["record_type"]
    )
    assert rows(newest)[0] == ("1", "beta")


def test_pivot(spark, rows):
    df = spark.createDataFrame(
        [("M1", "C03"), ("M1", "A01"), ("M1", "B02"), ("M1", "D09"), ("M2", "D04")],
        "member_id string, code string",
    )
    out = pivot_ranked(df, ["member_id"], "code", 3, "diagnosis")
    assert rows(out) == [("M1", "A01", "B02", "C03"), ("M2", "D04", None, None)]


def test_unpivot_and_latest_snapshot(spark, rows):
    df = spark.createDataFrame(
        [("M1", 10, 20, 30, "2024-01-01"), ("M2", 5, None, 15, "2024-01-01"),
         ("M1", 100, 200, 300, "2024-02-01"), ("M3", 7, None, 9, "2024-01-01")],
        "member_id string, q1 int, q2 int, q3 int, at string",
    )
    qs = ["q1", "q2", "q3"]
    old = df.filter("at = '2024-01-01'")
    assert rows(unpivot_columns(old.filter("member_id = 'M2'"), ["member_id"], qs)) == [
        ("M2", "q1", "5"), ("M2", "q3", "15")
    ]
    out = unpivot_latest(df, ["member_id"], qs, "at")
    assert rows(out, "member_id", "value") == [
        ("M1", "100"), ("M1", "200"), ("M1", "300"), ("M2", "15"), ("M2", "5"), ("M3", "7"), ("M3", "9")
    ]


def test_window_aggregation_gold(spark, rows):
    member = spark.createDataFrame([("M1",), ("M2",), (None,)], "member_id string")
    claims = spark.createDataFrame(
        [(1, "M1", "2024-01-01", "OPEN"), (2, "M1", "2024-02-01", "CLOSED"), (3, "M2", "2024-01-01", "OPEN"),
         (4, "M9", "2024-01-01", "VOID")],
        "claim_id int, member_id string, service_date string, status string",
    )
    base = key_universe([(member, "member_id"), (claims, "member_id")], "member")
    on = {"member": "member_id"}
    spec = TableDef(
        "stats",
        (ColumnSpec("member"), ColumnSpec("claims", "INTEGER"), ColumnSpec("status"),
         ColumnSpec("tier", default="std"), ColumnSpec("known", "BOOLEAN")),
    )
    out = derive(
        base,
        [
            Summarised(claims, "c", on, [Measure("n", "count(*)")]),
            Newest(claims, "l", on, ["service_date"], ["status"]),
            Joined(member.withColumn("meta_src", F.lit("x")), "m", on, ["member_id"]),
        ],
        spec,
        {
            "member": F.col("member"),
            "claims": F.col("c__n"),
            "status": F.col("l__status"),
            "known": F.col("m__member_id").isNotNull(),
        },
    )
    assert out.columns == ["member", "claims", "status", "tier", "known", "m__meta_src"]
    assert rows(out, "member", "claims", "status", "known") == [
        ("M1", "2", "CLOSED", "True"), ("M2", "1", "OPEN", "True"), ("M9", "1", "VOID", "False")
    ]


def test_survivorship(spark, rows):
    df = spark.createDataFrame(
        [("M1", "", "555-0001", 10, 20), ("M2", "555-0002", "x", None, 5), ("M3", None, None, None, None)],
        "k string, a string, b string, s int, t int",
    )
    c = F.col
    names = [sv.Candidate(c("b"), "second", 2), sv.Candidate(c("a"), "first", 1)]
    out = df.select(
        "k",
        sv.by_priority(names, "none", "string", text=True).alias("v"),
        sv.attribution(names, text=True).alias("from"),
        sv.greatest([sv.Candidate(c("s"), "s"), sv.Candidate(c("t"), "t")], -1, "int").alias("g"),
        sv.longest(names).alias("long"),
        sv.most_recent(
            [sv.Candidate(c("a"), "a", 1, F.lit(1)), sv.Candidate(c("b"), "b", 2, F.lit(2))], text=True
        ).alias("new"),
    )
    assert rows(out) == [
        ("M1", "555-0001", "second", "20", "555-0001", "555-0001"),
        ("M2", "555-0002", "first", "5", "555-0002", "x"),
        ("M3", "none", None, "-1", None, None),
    ]


def test_exclusions_flags_and_literals(spark, rows):
    df = spark.createDataFrame([(1, "null"), (2, "A"), (3, "Z")], "k int, v string")
    other = spark.createDataFrame([(1, True), (1, True), (2, False)], "id int, bad boolean")
    kept = exclude_matching(df, other, {"k": "id"}, "bad")
    assert rows(kept, "k") == [("2",), ("3",)]
    flagged = flag_matching(df, other, {"k": "id"}, "flag", "Y", "bad")
    assert rows(flagged, "k", "flag") == [("1", "Y"), ("2", None), ("3", None)]
    clean = null_literals(df).select("k", map_values(F.col("v"), {"A": "alpha"}, F.col("v")).alias("v"))
    assert rows(clean) == [("1", None), ("2", "alpha"), ("3", "Z")]
    assert rows(override(df, {"k": "k * 2", "w": "k + 1"}))[0] == ("2", "null", "2")
    loaded = df.withColumn("meta_load_dt", F.when(F.col("k") > 1, F.col("k")))
    assert rows(since(loaded, F.lit(2)), "k") == [("3",)]


def test_filtered_measures_share_a_null_key(spark):
    from tidewright.operators.aggregates import Measure, pre_aggregate

    df = spark.createDataFrame([(None, 1, "a"), (None, 2, "b"), (1, 5, "a"), (2, 7, "c")], "k int, v int, t string")
    measures = [
        Measure("a", "sum(v)", "t = 'a'"), Measure("b", "max(v)", "t = 'b'"), Measure("c", "sum(v) / count(v)", "t = 'b'"),
    ]
    found = {r.k: (r.a, r.b, r.c) for r in pre_aggregate(df, ["k"], measures).collect()}
    assert found == {None: (1, 2, 2.0), 1: (5, None, None)}
    simple = pre_aggregate(df, ["k"], measures[:2])
    assert simple._jdf.queryExecution().executedPlan().toString().count("Scan") <= 1


def test_merge_scores_any_number_of_stamps(spark):
    from pyspark.sql import functions as F

    from tidewright.operators.ranking import merge_winners

    rows = [(1, 0, 0, *[i % 2 for i in range(9)]), (1, 1, 0, *[1] * 8, 0), (None, 0, 1, *[None] * 9)]
    names = [f"t{i}" for i in range(9)]
    df = spark.createDataFrame(rows, "k int, src int, n int, " + ", ".join(f"{x} int" for x in names))
    won = merge_winners(df, ["k"], {x: F.col(x) for x in names}, "src", "n", audit=True).collect()
    assert sorted(((r.k, r.src, r.merge_score) for r in won), key=repr) == [(1, 1, 9), (None, 0, 0)]


def test_keys_stay_unique_beyond_a_billion_rows(spark):
    from pyspark.sql import functions as F

    from tidewright.synth.draws import unique_key, unique_number

    rows = spark.range(2000).select(F.explode(F.array("id", F.col("id") + 10**9, F.col("id") + 10**17)).alias("id"))
    for key in (unique_number(F.col("id"), 77, 9), unique_key(F.col("id"), "K")):
        assert rows.select(key.alias("k")).distinct().count() == 6000


@pytest.mark.parametrize(
    "name, operator, table",
    [("join_left_enrich", "enrich", "customer"), ("fk_orphans", "orphans", "orders"),
     ("fk_coverage", "fk_coverage", "supplier"), ("preagg_gold", "key_universe", "customer")],
)
def test_gaps_come_from_changed_keys_over_whole_tables(spark, monkeypatch, name, operator, table):
    plain, seen = getattr(joining, operator), []

    def watched(first, *rest, **named):
        seen.append(first[0][0] if operator == "key_universe" else rest[0])
        return plain(first, *rest, **named)

    monkeypatch.setattr(joining, operator, watched)
    sf = "/root/testdata/sf0.001"
    load_all()[name].run(spark, sf)
    assert seen[0].count() == spark.read.parquet(f"{sf}/{table}.parquet").count()
