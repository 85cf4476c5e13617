import random
from dataclasses import replace
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tidewright.catalog import lineage
from tidewright.catalog.lineage import edges_of
from tidewright.catalog.schemas import NotConformable, classify, column_facts, conform, schema_diff
from tidewright.corpus.chunks import chunk_documents, html_to_text, unit_vector
from tidewright.functions import canon
from tidewright.functions.domains import BY_NAME, DOMAINS, name_matches, spellings, type_fits
from tidewright.operators.joins import KeyPair, discover_foreign_keys, likely_foreign_keys, measure_foreign_keys
from tidewright.profiling.columns import pattern_regex, patterns, profile_columns
from tidewright.profiling.domains import infer_domains
from tidewright.profiling import keys
from tidewright.profiling.keys import key_candidates, promote_key
from tidewright.specs import ColumnSpec, TableDef, spec_of_schema


def test_profile_error_bound(spark):
    df = spark.range(20000).select("id", (F.col("id") % 97).alias("m"), F.col("id").cast("string").alias("s"))
    exact = {r.column_name: r for r in profile_columns(df, exact=True).collect()}
    rough = {r.column_name: r for r in profile_columns(df).collect()}
    for name in ("id", "m", "s"):
        assert rough[name].distinct_count == pytest.approx(exact[name].distinct_count, rel=0.15)
        assert rough[name].completeness == exact[name].completeness == 1.0
    assert rough["id"].p50 == pytest.approx(exact["id"].p50, rel=0.01)
    assert exact["s"].max_length == 5 and exact["m"].maximum == 96.0


def test_exact_quantiles_come_from_ranges(spark, monkeypatch):
    """The same quantiles as by one aggregate, which holds all values of a column; here no task sorts more than a range."""
    rng = random.Random(7)
    rows = [(None if i % 7 == 0 else rng.gauss(0, 50), rng.choice([1, 1, 1, 5, -3]), "x" * rng.randrange(30), None, float("nan") if i % 3 else 0.5) for i in range(3000)]
    df = spark.createDataFrame(rows, "a double, b int, c string, d double, e double").repartition(5)
    found = profile_columns(df, exact=True)
    assert "percentile(" not in found._jdf.queryExecution().analyzed().toString()
    by = {r.column_name: r for r in found.collect()}
    shares = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    for c in "abde":
        expected = df.agg(F.percentile(F.col(c).cast("double"), list(shares.values()))).first()[0] or [None] * 5
        assert repr([by[c][k] for k in shares]) == repr(list(expected)), c
    assert by["c"].median_length == df.agg(F.percentile(F.length("c"), 0.5)).first()[0]
    one = profile_columns(df.filter("c = 'xx'").limit(1).select("b", "c"), exact=True).collect()
    assert {r.column_name: r.median_length for r in one}["c"] == 2.0


def test_patterns(spark):
    df = spark.createDataFrame([("AB-12",), ("CD-34",), ("EF-5",), ("XY-99",), ("QQ-00",)], "v string")
    assert patterns(df).first().pattern == "AA-NN"
    mixed = spark.createDataFrame([(w,) for w in ("Boston", "Springfield", "Reno", "x1")], "v string")
    assert patterns(mixed).first().pattern == "Aa+"
    assert pattern_regex("AA-NN") == "^[A-Z][A-Z]-[0-9][0-9]$"
    assert pattern_regex("a+.N") == r"^[a-z]+\.[0-9]$"


def test_keys_are_minimal_and_exact(spark):
    df = spark.createDataFrame(
        [(i // 6, i // 3 % 2, i % 3, None if i == 0 else i) for i in range(30)], "a int, b int, c int, d int"
    )
    found = {r.columns: r for r in key_candidates(df).collect()}
    unique = [k for k, r in found.items() if r.is_unique]
    assert unique == ["a,b,c"] and found["a,b,c"].minimal is True
    assert "d" not in found
    counted = {r.columns: r for r in key_candidates(df, exact_counts=True).collect()}
    assert [k for k, r in counted.items() if r.is_unique] == ["a,b,c"] and counted["c"].distinct_count == 3
    ids = spark.range(50).select("id", (F.col("id") % 5).alias("g"))
    assert promote_key(key_candidates(ids)).first().columns == "id"


def test_key_search_agrees_with_counting_every_set(spark):
    """Random tables: the same minimal keys as by counting, however near to unique the sets are."""
    rng = random.Random(5)
    for n, spreads in ((400, (3, 20, 30, 400, 2000)), (900, (30, 31, 5, 2, 900))):
        rows = [tuple(rng.randrange(m) for m in spreads) for _ in range(n)]
        rows += [rows[0][:2] + (rows[0][2] + 1,) + rows[0][3:]]
        names = [f"`c.{i}`" for i in range(len(spreads))]
        df = spark.createDataFrame(rows, ", ".join(f"{c} int" for c in names))
        keys = []
        for w in (1, 2, 3):
            for s in combinations(range(len(spreads)), w):
                if not any(set(k) <= set(s) for k in keys) and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                    keys.append(s)
        found = [r["columns"] for r in key_candidates(df).collect() if r["is_unique"]]
        assert found == [",".join(f"c.{i}" for i in s) for s in keys]
    assert key_candidates(df.filter("false")).count() == 0


def test_a_level_of_keys_is_two_scans(spark, monkeypatch):
    """However many sets a level has: one aggregate of sketches, one count of those that may be unique."""
    calls = []
    for name in ("_estimates", "_distinct"):
        plain = getattr(keys, name)
        monkeypatch.setattr(keys, name, lambda *a, plain=plain, name=name: calls.append((name, len(a[1]))) or plain(*a))
    df = spark.range(300).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(12)], (F.col("id") % 150).alias("half"))
    key_candidates(df)
    assert [n for n, _ in calls].count("_estimates") <= 3 and len(calls) <= 6 and max(k for _, k in calls) > 50


def test_sets_with_repeats_are_not_counted_for_keys_only(spark, monkeypatch):
    """Near-unique sets fall by repeats in one part of their tuples; the keys are those of counting every set."""
    counted = []
    plain = keys._distinct
    monkeypatch.setattr(keys, "_distinct", lambda *a: counted.append(len(a[1])) or plain(*a))
    rng = random.Random(3)
    rows = [(i // 2, *[rng.randrange(150) for _ in range(5)], i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, ", ".join(f"c{i} int" for i in range(7))).coalesce(1)

    def found(**options):
        counted.clear()
        return sorted((r["columns"], r["distinct_count"]) for r in key_candidates(df, **options).collect() if r["is_unique"]), sum(counted)

    (every, many), (quick, few) = found(), found(count_repeated=False)
    assert quick == every and ("c0,c6", 4000) in every and few < many / 2


def test_large_counts_shuffle_rows_and_leave_no_files(spark, monkeypatch):
    """Counts of large tables, forced here: exact with a heavy value too, rows are dealt instead of tuples, no shuffle file stays."""
    for name, value in (("AT_ONCE", 0), ("SCANS", 1), ("MANY", 500), ("TOGETHER", 4)):
        monkeypatch.setattr(keys, name, value)
    rng = random.Random(11)
    rows = [(7 if i % 3 else i, i // 2, rng.randrange(1500), rng.choice("xyz")) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d string").repartition(4)
    sets = [(0, 1), (0, 3), (1, 2), (0, 2, 3), (0, 1, 3), (1, 2, 3)]
    brute = {s: len({tuple(r[i] for i in s) for r in rows}) for s in sets}
    sizes = {i: len({r[i] for r in rows}) for i in range(4)}
    table = keys._Rows(df.toDF("c0", "c1", "c2", "c3"), keys._hashed(df, df.columns), len(rows), sizes)
    assert keys._distinct(table, sets) == brute and table.heavy[0]
    repeated = keys._repeated(table, sets)
    assert repeated and repeated <= {s for s, n in brute.items() if n < len(rows)}
    kept = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {f.getName() for f in (kept.getAllFiles().apply(i) for i in range(kept.getAllFiles().size())) if f.getName().startswith("shuffle_")}

    before, ids = files(), spark.range(0, 4000, 1, 4).select("id", (F.col("id") % 61).alias("m"), (F.col("id") * 7 % 4000).alias("n"))
    doubled = ids.union(ids.withColumn("m", F.col("m") + 61))
    found = key_candidates(doubled, count_repeated=False).collect()
    assert {r["columns"] for r in found if r["is_unique"]} == {"id,m", "m,n"}
    assert not files() - before and spark.conf.get(keys.CLEANUP, None) is None


def test_foreign_keys_are_found_by_sketches_then_measured(spark):
    ids = spark.range(30_000).select("id", (F.col("id") + 29_990).alias("late"), F.col("id").cast("string").alias("code"))
    facts = spark.range(60_000).select(
        (F.col("id") * 7 % 20_000).alias("ref"), (F.col("id") % 30_001).alias("beyond"), F.lit(None).cast("long").alias("none"),
        (F.col("id") % 9).cast("string").alias("digit"), F.col("id").cast("double").alias("measure"))
    frames = {"ids": ids, "facts": facts}
    found = {(r["child_column"], r["parent_column"], r["cardinality"]) for r in discover_foreign_keys(frames).collect()}
    assert found == {("ref", "id", "1:N"), ("digit", "code", "1:N")}
    assert KeyPair("facts", "beyond", "ids", "id") in likely_foreign_keys(frames, 0.9)
    loose = {(r["child_column"], r["parent_column"]) for r in discover_foreign_keys(frames, 0.9).collect()}
    assert ("beyond", "id") in loose and ("id", "late") not in loose
    assert discover_foreign_keys({"facts": facts.select("none", "measure")}).count() == 0


def test_pairs_are_measured_with_one_scan_and_shuffle_per_table(spark, tmp_path):
    for name in ("a", "b"):
        spark.range(100).select("id", (F.col("id") % 7).alias("x"), (F.col("id") % 5).alias("y")).write.parquet(str(tmp_path / name))
    frames = {n: spark.read.parquet(str(tmp_path / n)) for n in ("a", "b")}
    found = measure_foreign_keys(frames, [KeyPair("a", c, "b", d) for c in ("id", "x", "y") for d in ("id", "x", "y")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1


def test_domain_names():
    assert spellings("mbr_dt") == {"mbr_dt", "member_dt", "mbr_date", "member_date"}
    assert name_matches(BY_NAME["us_state_code"], "mbr_st")
    assert type_fits(BY_NAME["birth_date"], "TimestampType") and not type_fits(BY_NAME["birth_date"], "STRING")
    assert len(DOMAINS) == 42


def test_domain_inference_runner_up(spark):
    df = spark.createDataFrame([("12345",), ("54321-1234",)], "zip_code string")
    row = infer_domains(df, ["zip_code"]).first()
    assert row.domain == "zip_code" and row.confidence == 1.0 and "values 2/2" in row.explanation
    nothing = infer_domains(df.withColumnRenamed("zip_code", "qqq"), ["qqq"]).first()
    assert nothing.confidence < 1.0


def test_foreign_key_measures(spark):
    parents = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    children = spark.createDataFrame([(1,), (1,), (9,), (None,)], "parent_id int")
    pair = KeyPair("c", "parent_id", "p", "id")
    row = measure_foreign_keys({"c": children, "p": parents}, [pair]).first()
    assert (row.child_values, row.shared_values, row.inclusion, row.cardinality) == (2, 1, 0.5, "1:N")


def test_compatibility_rules(spark, rows):
    def spec(*columns):
        return TableDef("t", columns)

    old = spec(
        ColumnSpec("a", "INTEGER"), ColumnSpec("b", "VARCHAR", length=10), ColumnSpec("c", "DECIMAL", precision=10, scale=2),
        ColumnSpec("d", "EMBEDDING", dimension=64), ColumnSpec("e"), ColumnSpec("gone"), ColumnSpec("was"),
    )
    new = spec(
        ColumnSpec("a", "DECIMAL"), ColumnSpec("b", "VARCHAR", length=5), ColumnSpec("c", "DECIMAL", precision=12, scale=2),
        ColumnSpec("d", "EMBEDDING", dimension=128), ColumnSpec("e", nullable=False), ColumnSpec("now", aliases=("was",)),
        ColumnSpec("opt"), ColumnSpec("req", nullable=False),
    )
    found = classify(schema_diff(column_facts(spark, [old]), column_facts(spark, [new])))
    assert {(r.column_name, r.finding, r.severity) for r in found.collect()} == {
        ("a", "type_widened", "info"), ("b", "length_narrowed", "breaking"), ("c", "precision_widened", "info"),
        ("d", "dimension_changed", "breaking"), ("e", "nullable_tightened", "breaking"),
        ("gone", "removed", "breaking"), ("now", "renamed", "info"), ("opt", "added", "info"),
        ("req", "added_required", "breaking"),
    }
    same = classify(schema_diff(column_facts(spark, [old]), column_facts(spark, [old])))
    assert same.isEmpty()


def test_conform_refuses_loss(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    wide = replace(spec_of_schema("t", df.schema), columns=(ColumnSpec("b"), ColumnSpec("a", "INTEGER", bits=64), ColumnSpec("n", "DATE")))
    out = conform(df, wide.schema)
    assert out.dtypes == [("b", "string"), ("a", "bigint"), ("n", "date")]
    with pytest.raises(NotConformable):
        conform(out, df.schema)


def test_lineage_with_cycle(spark, rows):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x"), ("y", "z")], "src string, dst string"
    )
    assert rows(lineage.levels(edges)) == [
        ("a", "0"), ("b", "1"), ("c", "2"), ("x", None), ("y", None), ("z", None)
    ]
    assert rows(lineage.cycles(edges)) == [("x",), ("y",)]
    pairs = {(r.ancestor, r.descendant): r.depth for r in lineage.closure(edges).collect()}
    assert pairs["a", "c"] == 1 and pairs["x", "x"] == 2 and len(pairs) == 9
    changed = spark.createDataFrame([("b",)], "n string")
    assert rows(lineage.impacted(edges, changed)) == [("b",), ("c",)]
    groups = dict(tuple(r) for r in lineage.connected_groups(edges).collect())
    assert groups == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "z": "x"}


def test_long_chain_is_one_group(spark):
    chain = spark.range(60).select(
        F.concat(F.lit("n"), F.lpad(F.col("id").cast("string"), 3, "0")).alias("src"),
        F.concat(F.lit("n"), F.lpad((F.col("id") + 1).cast("string"), 3, "0")).alias("dst"),
    )
    found = lineage.connected_groups(chain)
    assert [r["group"] for r in found.select("group").distinct().collect()] == ["n000"]
    assert found.count() == 61


def test_chunks(spark):
    text = " ".join(f"w{i}" for i in range(25))
    df = spark.createDataFrame([("d", text), ("blank", "  "), ("one", "word")], "id string, t string")
    out = chunk_documents(df, "id", "t", words_per_chunk=10, overlap=3).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.word_count) for r in out] == [
        ("d:0000", 10), ("d:0001", 10), ("d:0002", 10), ("d:0003", 4), ("one:0000", 1)
    ]
    assert out[1].text.split()[0] == "w7"
    html = spark.createDataFrame([("<p>a<b>b</b>\n c</p>",)], "h string")
    assert html.select(html_to_text(F.col("h"))).first()[0] == "a b c"


def test_unit_vectors(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",)], "t string")
    found = [r[0] for r in df.select(unit_vector(F.col("t"), 48)).collect()]
    assert found[0] == found[1] != found[2] and len(found[0]) == 48
    assert sum(v * v for v in found[0]) == pytest.approx(1.0, abs=1e-5)
    with pytest.raises(ValueError):
        unit_vector(F.col("t"), 0)


def test_canonical_forms(spark):
    df = spark.createDataFrame([(True, "1.50", None)], "b boolean, d string, n string").select(
        "b", F.col("d").cast("decimal(5,2)").alias("d"), "n",
        F.lit("2024-01-02 03:04:05.999999").cast("timestamp_ntz").alias("t"),
        F.lit("2024-01-02").cast("date").alias("day"),
    )
    row = canon.canonical_rows(df, digits=3).first().asDict()
    assert row == {"b": "true", "d": "1.50", "day": "2024-01-02", "n": "NULL", "t": "2024-01-02 03:04:05.999"}
    same = canon.row_differences(df.union(df), df.union(df).repartition(3))
    assert same.isEmpty()
    assert canon.row_differences(df.union(df), df).first().surplus == 1


def test_profile_of_an_empty_table(spark):
    found = profile_columns(spark.createDataFrame([], "a int, b string, c array<int>")).collect()
    assert [(r.row_count, r.non_null, r.completeness) for r in found] == [(0, 0, 0.0)] * 3


def test_edges_of_lists_both_kinds(spark, rows):
    found = edges_of(spark, [("raw", "x", "gold", "y")], [("child", "fk", "parent", "id")])
    assert rows(found, "src", "dst", "kind") == [
        ("parent.id", "child.fk", "foreign_key"), ("raw.x", "gold.y", "derivation"),
    ]


def test_lineage_rounds_write_the_result_once(spark, monkeypatch):
    """A chain with a branch, a cycle and a tail behind it: rows over all rounds are the result's, each once."""
    added = []
    plain = lineage._Rounds.add
    monkeypatch.setattr(lineage._Rounds, "add", lambda self, rows, k: added.append((self.number, plain(self, rows, k))) or added[-1][1])
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)] + [("n03", "b"), ("b", "n09"), ("x", "y"), ("y", "x"), ("y", "z"), ("z", "n12")]
    edges = spark.createDataFrame([*chain, chain[0], (None, "n00")], "src string, dst string")
    expected = {}
    for start in {s for s, _ in chain}:
        near, depth = {start}, 0
        while near:
            depth += 1
            near = {d for s, d in chain if s in near and (start, d) not in expected}
            expected |= {(start, d): depth for d in near}
    found = lineage.closure(edges)
    assert {(r.ancestor, r.descendant): r.depth for r in found.collect()} == expected
    assert sum(df.count() for _, df in added) == len(expected) == found.count()
    added.clear()
    levels = {r.node: r.level for r in lineage.levels(edges).collect()}
    assert levels["n00"] == 0 and levels["n09"] == 9 and levels["b"] == 4 and levels["n11"] == 11
    assert {n for n, v in levels.items() if v is None} == {"x", "y", "z", "n12"}
    assert sum(df.count() for name, df in added if name == "level") == 13
    added.clear()
    hit = lineage.impacted(edges, spark.createDataFrame([("y",)], "node string"), spark.createDataFrame([("z",)], "node string"))
    assert {r.node for r in hit.collect()} == {"x", "y", "n12"} and sum(df.count() for _, df in added) == 4
    assert lineage.closure(edges.filter("false")).count() == 0 and lineage.levels(edges.filter("false")).count() == 0
