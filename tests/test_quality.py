import math
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tidewright.profiling.columns import frequent_values, profile_columns
from tidewright.quality import drift, runs, scoring
from tidewright.quality.actions import action_of, row_constraints, split_rows
from tidewright.quality.spec_checks import date_pairs, implied_checks
from tidewright.quality.suite import Context, failure_samples, run_staged, run_suite, stage_of, value_of
from tidewright.specs import Check, ColumnSpec, TableDef


def outcome(df, *checks, context=None):
    return {r.check_id: r.status for r in run_suite(df, checks, context).collect()}


@pytest.fixture(scope="module")
def tiers(spark):
    return spark.createDataFrame(
        [(1, "MD", 2), (2, "XX", 9), (3, None, 1), (3, "ME", None)], "id int, lob string, tier int"
    )


def test_accepted_values_and_uniqueness(tiers):
    found = outcome(
        tiers,
        Check("expect_column_values_to_be_in_set", "lob", {"value_set": ["MD", "MP", "ME"]}, id="lob"),
        Check("column_values_to_be_in_set", "lob", {"value_set": ["MD", "ME"]}, id="mostly", mostly=0.6),
        Check("column_values_to_be_unique", "id", id="unique"),
        Check("compound_columns_to_be_unique", params={"column_list": ["id", "lob"]}, id="pair"),
        Check("compound_columns_to_be_unique",
              params={"column_list": ["id", "lob"], "ignore_row_if": "sometimes"}, id="bad_rule"),
        Check("compound_columns_to_be_unique", params={"column_list": ["id"]}, id="narrow"),
    )
    assert found == {"lob": "failed", "mostly": "passed", "unique": "failed", "pair": "passed",
                     "bad_rule": "failed", "narrow": "failed"}


def test_compound_null_rules(spark):
    df = spark.createDataFrame([(None, None), (None, None), (1, None), (1, None)], "a int, b int")

    def pair(rule):
        params = {"column_list": ["a", "b"], "ignore_row_if": rule}
        result = run_suite(df, [Check("compound_columns_to_be_unique", params=params, id="x")]).first()
        return result.element_count, result.unexpected_count

    assert pair("never") == (4, 4)
    assert pair("all_values_are_missing") == (2, 2)
    assert pair("any_value_is_missing") == (0, 0)


def test_empty_population_passes_and_text_fails_ranges(spark):
    empty = spark.createDataFrame([], "v string")
    texts = spark.createDataFrame([("5",), ("many",)], "v string")
    check = Check("column_values_to_be_between", "v", {"min_value": 1, "max_value": 9}, id="r")
    assert outcome(empty, check) == {"r": "passed"}
    assert value_of(run_suite(texts, [check]), "r", "unexpected_count") == 1


def test_fail_closed_keeps_every_check(tiers):
    checks = [
        Check("no_such_type", id="a"),
        Check("column_values_to_not_be_null", "nope", id="b"),
        Check("column_values_to_not_be_null", "id", where="syntax error here", id="c"),
        Check("validation_rule_pending_implementation", id="d"),
        Check("column_values_to_not_be_null", "id", id="e"),
        Check("row_count_change_within_percent", id="f"),
    ]
    found = outcome(tiers, *checks)
    assert found == {"a": "failed", "b": "failed", "c": "failed", "d": "pending", "e": "passed",
                     "f": "failed"}
    scored = scoring.score(run_suite(tiers, checks)).first()
    assert (scored.total_checks, scored.failed_checks) == (5, 4)


def test_many_checks_are_one_action(spark, tiers):
    checks = [Check("column_values_to_not_be_null", "id", id=f"c{i}") for i in range(130)]
    group = "one-action"
    spark.sparkContext.setJobGroup(group, "suite")
    results = run_suite(tiers, checks).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(results) == 130 and all(r.success for r in results)


def test_stages(spark, tiers):
    checks = [
        Check("column_values_to_be_between", "tier", {"max_value": 3}, id="t"),
        Check("column_values_to_match_regex", "lob", {"regex": "^M"}, id="r"),
        Check("column_to_exist", "lob", id="s"),
    ]
    assert [stage_of(c) for c in checks] == ["ingested", "raw", "redundant"]
    assert stage_of(replace(checks[0], stage="raw")) == "raw"
    found = {r.check_id: (r.stage, r.status) for r in run_staged(tiers, tiers, checks).collect()}
    assert found == {"t": ("ingested", "failed"), "r": ("raw", "failed"), "s": ("redundant", "skipped")}


def test_gate(tiers):
    checks = [Check("column_values_to_be_unique", "id", severity="error", blocking=True, id="u"),
              Check("column_values_to_not_be_null", "id", id="n")]
    scored = scoring.score(run_suite(tiers, checks))
    row = scoring.gate(scored).first()
    assert (row.success_rate, row.critical_failures, row.should_block) == (50.0, 1, True)
    softer = scoring.score(run_suite(tiers, [replace(checks[0], blocking=False), checks[1]]))
    assert scoring.gate(softer).first().should_block is False
    assert scoring.gate(softer, scoring.Thresholds(max_failures=0)).first().threshold_breached is True
    empty = scoring.score(run_suite(tiers, [])).first()
    assert (empty.total_checks, empty.success_rate) == (0, 0.0)


def test_actions(tiers, rows):
    assert action_of(Check("x", severity="info")) == "WARN"
    assert action_of(Check("x", severity="info", blocking=True)) == "FAIL"
    spec = TableDef(
        "t",
        (ColumnSpec("id", nullable=False), ColumnSpec("lob"), ColumnSpec("tier")),
        checks=(Check("accepted_values", "lob", {"value_set": ["MD", "ME"]}),),
    )
    split = split_rows(tiers, row_constraints(spec))
    assert split.clean.count() == 3 and split.fatal.count() == 0
    assert rows(split.quarantined, "id", "_violations") == [("2", "['accepted_values:lob']")]


def test_samples_are_bounded(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("v"))
    found = failure_samples(df, [Check("column_values_to_match_regex", "v", {"regex": "^x"}, id="r")])
    assert found.count() == 10
    again = failure_samples(df.repartition(9), [Check("column_values_to_match_regex", "v", {"regex": "^x"}, id="r")])
    assert sorted(found.collect()) == sorted(again.collect())


def test_monotonic_matches_brute_force(spark):
    values = [(i, (i * 37) % 101) for i in range(3000)]
    df = spark.createDataFrame(values, "o int, v int").repartition(11)
    order = {"order_by": ["o"]}
    found = run_suite(df, [Check("column_values_to_be_increasing", "v", order, id="up"),
                           Check("column_values_to_be_decreasing", "v", order, id="down")])
    seq = [v for _, v in values]
    up = sum(b < a for a, b in zip(seq, seq[1:]))
    down = sum(b > a for a, b in zip(seq, seq[1:]))
    assert {r.check_id: r.unexpected_count for r in found.collect()} == {"up": up, "down": down}


def test_date_pairs_and_implied_checks():
    assert date_pairs(["start_day", "end_day", "begin_x", "to_x", "other"]) == [
        ("start_day", "end_day"), ("begin_x", "to_x")
    ]
    spec = TableDef(
        "t",
        (ColumnSpec("a", "DATE", format="MM/DD/YYYY", nullable={"x": False, "y": True}),
         ColumnSpec("v", "EMBEDDING", dimension=64), ColumnSpec("z", domain="zip_code")),
        context_column="ctx",
    )
    kinds = [c.type for c in implied_checks(spec)]
    assert "column_values_to_match_strftime_format" in kinds
    assert "column_values_to_match_domain_type" in kinds
    assert any(c.where == "ctx = 'x'" for c in implied_checks(spec))
    native = [c.type for c in implied_checks(spec, native=["a"])]
    assert "column_values_to_cast_to_type" not in native


def js(p, q):
    keys = set(p) | set(q)
    a = [p.get(k, 1e-10) for k in keys]
    b = [q.get(k, 1e-10) for k in keys]
    a, b = [x / sum(a) for x in a], [x / sum(b) for x in b]
    m = [(x + y) / 2 for x, y in zip(a, b)]
    kl = lambda u: sum(x * math.log(x / y) for x, y in zip(u, m))
    return min((kl(a) + kl(b)) / 2 / math.log(2), 1.0)


def test_divergence_properties(spark):
    def frame(**counts):
        return spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "c string")

    def d(a, b):
        return drift.distribution_drift(a, b, ["c"]).first().js_divergence

    one, two, far = frame(x=3, y=1), frame(x=1, y=2, z=1), frame(q=5)
    assert d(one, one) == 0.0
    assert d(one, two) == d(two, one) == pytest.approx(js({"x": 0.75, "y": 0.25},
                                                          {"x": 0.25, "y": 0.5, "z": 0.25}), abs=1e-6)
    assert d(one, far) == pytest.approx(1.0, abs=1e-6)


def test_record_hash_sees_null_positions(spark):
    df = spark.createDataFrame([("a", None, "b"), ("a", "b", None)], "x string, y string, z string")
    hashes = df.select(drift.record_hash(df, ["x", "y", "z"])).distinct()
    assert hashes.count() == 2


def test_reconcile(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, None), (4, "d")], "k int, v string")
    row = drift.record_summary(old, new, ["k"]).first()
    assert (row.added_count, row.removed_count, row.modified_count, row.unchanged_count) == (1, 1, 1, 1)
    assert row.added_percent == pytest.approx(33.333333)


def test_distribution_keeps_the_tail(spark):
    df = spark.range(500).select(F.when(F.col("id") < 200, "hot").otherwise(F.col("id").cast("string")).alias("v"))
    found = {r.value: r.n for r in drift.distribution(df, ["v"], top=5).collect()}
    assert found["hot"] == 200 and found["__OTHER__"] == 296 and sum(found.values()) == 500


def test_run_over_run_default(spark):
    old, new = spark.range(100).toDF("k"), spark.range(130).toDF("k")
    check = Check("row_count_change_within_percent", id="r")
    assert outcome(new, check, context=Context(baseline=old)) == {"r": "failed"}
    assert outcome(old, check, context=Context(baseline=old)) == {"r": "passed"}


def test_real_texts_spelled_like_markers_survive(spark):
    df = spark.createDataFrame([(v,) for v in ["__NULL__"] * 3 + [None] * 2 + ["__OTHER__"] + list("abcd")], "v string")
    found = {(r.value, r.kind): r.n for r in drift.distribution(df, ["v"], top=3).collect()}
    assert found == {("__NULL__", "value"): 3, ("__NULL__", "null"): 2, ("__OTHER__", "value"): 1, ("__OTHER__", "other"): 4}
    facts = drift.distribution_facts(df, ["v"]).first()
    assert (facts.total_count, facts.distinct_count, facts.null_count) == (10, 6, 2)
    moved = drift.changed_values(df, df.filter("v is null or v <> '__NULL__'"), ["v"]).collect()
    assert [(r.change, r.value) for r in moved] == [("removed", "__NULL__")]
    assert [r.value for r in frequent_values(df).orderBy("rank").collect()][:2] == ["__NULL__", "__OTHER__"]


def test_low_cardinality_is_told_exactly(spark):
    df = spark.range(5000).select(*[(F.col("id") % n).cast("string").alias(f"c{n}") for n in (1, 99, 100, 101, 4000)], F.lit(None).cast("string").alias("empty"))
    assert drift.low_cardinality_columns(df) == ["c1", "c99", "c100", "empty"]
    assert drift.low_cardinality_columns(df, most=4000) == [*[f"c{n}" for n in (1, 99, 100, 101, 4000)], "empty"]
    plan = df.agg(F.theta_sketch_agg("c4000", 8))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("FileScan")


def test_scans_do_not_grow_with_the_suite(spark, tmp_path):
    """Ten checks and over four hundred of all shared kinds: three scans, and the same verdicts."""
    names = [f"c{i}" for i in range(40)]
    spark.range(2000).select(*[(F.col("id") % (i + 3)).alias(c) for i, c in enumerate(names)]).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))

    def suite(columns):
        found = []
        for c in columns:
            found += [
                Check("column_values_to_not_be_null", c), Check("column_values_to_be_between", c, {"min_value": 0, "max_value": 20}),
                Check("column_values_to_be_in_set", c, {"value_set": list(range(10))}, mostly=0.2), Check("column_max_to_be_between", c, {"max_value": 30}),
                Check("column_mean_to_be_between", c, {"min_value": 1}), Check("column_stdev_to_be_between", c, {"max_value": 99}),
                Check("column_median_to_be_between", c, {"max_value": 99}), Check("column_values_to_be_unique", c),
                Check("column_unique_value_count_to_be_between", c, {"max_value": 25}),
                Check("column_most_common_value_to_be_in_set", c, {"value_set": [0, 1]}, where=f"{c} < 2"),
            ]
        pairs = zip(columns, columns[1:])
        return found + [Check("compound_columns_to_be_unique", params={"column_list": [a, b]}, id=f"{a}+{b}") for a, b in pairs]

    few, many = run_suite(df, suite(names[:1])), run_suite(df, suite(names))
    assert scans(few) == scans(many) == 3
    found = {r.check_id: r.status for r in many.collect()}
    assert len(found) == 439 and all(found[r.check_id] == r.status for r in few.collect())
    for i, c in enumerate(names):
        assert found[f"column_values_to_be_unique:{c}"] == "failed" and found[f"column_most_common_value_to_be_in_set:{c}"] == "passed"
        assert found[f"column_values_to_be_between:{c}"] == ("passed" if i + 3 <= 21 else "failed")
        assert found[f"column_unique_value_count_to_be_between:{c}"] == ("passed" if i + 3 <= 25 else "failed")
        if i:
            n = math.lcm(i + 2, i + 3)
            assert found[f"c{i - 1}+{c}"] == ("passed" if n >= 2000 else "failed")
    assert scans(profile_columns(df.select(names[:2]))) == scans(profile_columns(df)) == 2
    assert scans(profile_columns(df.select(*[F.col(c).cast("double") for c in names]))) == 3


def test_groups_tell_missing_parts_apart(spark):
    df = spark.createDataFrame([("x", None), (None, "x"), (None, None), (None, None), ("y", "z"), ("y", "z")], "a string, b string")
    def unexpected(how):
        check = Check("compound_columns_to_be_unique", params={"column_list": ["a", "b"], "ignore_row_if": how})
        row = run_suite(df, [check]).first()
        return row.element_count, row.unexpected_count
    assert unexpected("never") == (6, 4) and unexpected("all_values_are_missing") == (4, 2) and unexpected("any_value_is_missing") == (2, 2)


def test_default_check_and_skipped_ones(spark):
    df = spark.range(10).select("id")
    some = Check("column_values_to_not_be_null", "id")
    assert [c.type for c in runs.with_defaults([some])] == ["row_count_change_within_percent", some.type]
    assert runs.with_defaults([replace(some, tags=("skip_defaults",))])[0].type == some.type
    own = Check("expect_row_count_change_within_percent", params={"max_change_percent": 1})
    assert runs.with_defaults([own]) == [own]
    skipped = replace(some, severity="skip", id="idle")
    for before, status in ((spark.range(9), "passed"), (spark.range(2), "failed"), (None, "skipped")):
        found = {r.check_id: r.status for r in runs.run_checks(df, [some, skipped], Context(baseline=before)).collect()}
        assert found == {"row_count_change_within_percent": status, some.check_id: "passed", "idle": "skipped"}


def test_history_has_its_columns_and_types(spark, tmp_path):
    checks = [Check("column_values_to_not_be_null", "id", description="key", tags=("k",)), Check(runs.SKIP_DEFAULTS, tags=("skip_defaults",), id="odd")]
    results = runs.run_checks(spark.range(3).select("id"), checks)
    rows = runs.history_rows(results, runs.Run("r1", "2024-05-01 10:00:00", "p", "t"), checks)
    assert rows.schema.names == runs.HISTORY_SCHEMA.names and len(rows.columns) == 28
    runs.append_history(rows, str(tmp_path / "h"))
    runs.append_history(rows.withColumns({"run_id": F.lit("r2"), "run_timestamp": F.lit("2024-05-02 10:00:00").cast("timestamp")}), str(tmp_path / "h"))
    back = runs.read_history(spark, str(tmp_path / "h"), table="t")
    assert back.schema.simpleString() == runs.HISTORY_SCHEMA.simpleString()
    assert [r.run_id for r in back.collect()] == ["r2", "r2", "r1", "r1"]
    assert {r.description for r in back.collect()} == {"key", None} and back.first().total_checks == 2
    for wrong in (rows.drop("check_id"), rows.withColumn("more", F.lit(1)), rows.withColumn("success", F.lit("yes"))):
        with pytest.raises(runs.HistoryMismatch):
            runs.append_history(wrong, str(tmp_path / "h"))
    with pytest.raises(Exception, match="run_id is NULL"):
        runs.append_history(rows.withColumn("run_id", F.lit(None).cast("string")), str(tmp_path / "h"))
