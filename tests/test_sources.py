import csv
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.functions.naming import identifier
from tidewright.sinks import writers
from tidewright.sources.dialect import Delimited, charset
from tidewright.sources.dumps import OpenQuote
from tidewright.sources.files import MissingPath, read_delimited, read_json
from tidewright.sources.headers import MissingColumns, header_mapping, resolve_headers
from tidewright.sources.jdbc import Jdbc, UnresolvedSecret, jdbc_options, read_jdbc
from tidewright.sources.provenance import META_COLUMNS, check_captures, with_provenance
from tidewright.specs import ColumnSpec, TableDef


def land(tmp_path, text, name="f.txt"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path)


def test_skip_rows(spark, rows, tmp_path):
    path = land(tmp_path, "made by x\n-----\nid|v\ns1|a\ns2|b\n")
    assert rows(read_delimited(spark, path, Delimited(skip_rows=2))) == [("s1", "a"), ("s2", "b")]


def test_footer_rows(spark, rows, tmp_path):
    path = land(tmp_path, "id|v\nf1|a\nf2|b\n2\n")
    assert rows(read_delimited(spark, path, Delimited(footer_rows=1))) == [("f1", "a"), ("f2", "b")]


def test_record_terminator(spark, rows, tmp_path):
    path = land(tmp_path, "id,v||lt1,a||lt2,b||")
    how = Delimited(delimiter=",", line_terminator="||")
    assert rows(read_delimited(spark, path, how)) == [("lt1", "a"), ("lt2", "b")]


def test_null_marks_and_comments(spark, rows, tmp_path):
    path = land(tmp_path, "id|v\n1|NULL\n#2|gone\n3|\\N\n4|keep\n")
    how = Delimited(null_value="NULL", null_escape=r"\N", comment="#")
    assert rows(read_delimited(spark, path, how)) == [("1", None), ("3", None), ("4", "keep")]


def test_dump_files_have_their_own_edges_and_headers(spark, rows, tmp_path):
    land(tmp_path, "pre\nid|v\na1|x\na2|y\nend\n", "a.txt")
    land(tmp_path, "pre\nv|id\nz|b1\nend\n", "b.txt")
    land(tmp_path, "pre\nid|v\nend\n", "empty.txt")
    out = read_delimited(spark, str(tmp_path), Delimited(skip_rows=1, footer_rows=1))
    assert rows(out, "id", "v") == [("a1", "x"), ("a2", "y"), ("b1", "z")]


def test_dump_blocks_of_one_file(spark, rows, tmp_path):
    """A file read in many splits keeps its own first and last records."""
    body = "".join(f"{i}|v{i}\n" for i in range(2000))
    path = land(tmp_path, "p1\np2\nid|v\n" + body + "f1\nf2\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        out = read_delimited(spark, path, Delimited(skip_rows=2, footer_rows=2))
        assert out.rdd.getNumPartitions() > 5
        assert sorted(int(r.id) for r in out.collect()) == list(range(2000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.fixture()
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, "300")
    yield
    spark.conf.set(name, before)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_line_ends_across_blocks(spark, small_blocks, tmp_path, seed):
    """Cells with breaks, quotes and delimiters, against Python's own parser over the same lines."""
    rng = random.Random(seed)
    how = Delimited(delimiter=",", quote='"', skip_rows=1, footer_rows=1, comment="#", escape="\\" if seed % 2 else None)
    pieces = ["a", " ", "x y", '"', '""', ",", "\n", "\n#no\n", "long " * 9, "\n\n", "|", "é"] + (["\\", "\\n"] if seed % 2 else [])
    expected = []
    for name in ("one.txt", "two.txt", "plain.txt"):
        body = []
        for i in range(150):
            cells = [f"{name}{i}"]
            for _ in range(rng.randrange(1, 5)):
                text = "".join(rng.choice(pieces[:3] if name == "plain.txt" else pieces) for _ in range(rng.randrange(4)))
                text = text.replace("\\", "\\\\") if seed % 2 else text
                if any(c in text for c in '",\n') or rng.random() < 0.2:
                    text = '"' + text.replace('"', '""') + '"' + rng.choice(["", "", 'tail"s'])
                elif rng.random() < 0.1 and text:
                    text += '"'
                cells.append(text)
            body.append(",".join(cells) + rng.choice(["", "", "\n# a comment", "\n"]))
        text = '"not, a record\nid,v,w,"x y",\n' + "\n".join(body) + '\nfoot"er'
        (tmp_path / name).write_text(text)
        lines = [x for x in text.split("\n")[1:-1] if not x.startswith("#")]
        extra = {"escapechar": "\\"} if seed % 2 else {}
        for r in csv.DictReader(io.StringIO("\n".join(lines), newline=""), delimiter=",", quotechar='"', **extra):
            expected.append(tuple(r[c] for c in ("id", "v", "w", "x y")))
    out = read_delimited(spark, str(tmp_path), how)
    assert out.columns == ["id", "v", "w", "x y"]
    found = sorted(map(tuple, out.collect()), key=repr)
    assert found == sorted(expected, key=repr) and any("\n" in c for r in found for c in r if c)


def test_quotes_count_only_where_declared(spark, rows, tmp_path):
    path = land(tmp_path, 'id|v\n1|"a\n2|5" pipe\n3|\n4\n5|x|y\n')
    expected = [("1", '"a'), ("2", '5" pipe'), ("3", ""), ("4", None), ("5", "x")]
    assert rows(read_delimited(spark, path, Delimited(null_escape=r"\N"))) == expected


def test_a_quote_left_open_is_an_error(spark, small_blocks, tmp_path, monkeypatch):
    monkeypatch.setattr("tidewright.sources.dumps.MOST_RECORD_LINES", 50)
    path = land(tmp_path, 'id|v\n1|"a\n' + "".join(f"{i}|x\n" for i in range(200)))
    with pytest.raises(OpenQuote, match="f.txt"):
        read_delimited(spark, path, Delimited(quote='"', null_escape=r"\N"))


def test_dump_without_a_header_names_its_columns(spark, rows, tmp_path):
    land(tmp_path, "pre\na1|x|1\na2|y|2|beyond\n", "a.txt")
    land(tmp_path, "pre\n#c\n\nb1|z\n", "b.txt")
    land(tmp_path, "pre\n", "none.txt")
    out = read_delimited(spark, str(tmp_path), Delimited(header=False, skip_rows=1, comment="#"))
    assert out.columns == ["column0", "column1", "column2"]
    assert rows(out) == [("a1", "x", "1"), ("a2", "y", "2"), ("b1", "z", None)]
    named = read_delimited(spark, str(tmp_path), Delimited(header=False, skip_rows=1, comment="#"), columns=["k", "v"])
    assert rows(named) == [("a1", "x"), ("a2", "y"), ("b1", "z")]


def test_dump_layouts_are_one_parse(spark, rows, tmp_path):
    for i in range(12):
        names = [f"c{(i + k) % 12}" for k in range(4)] + (["ID", ""] if i % 2 else ["id"])
        land(tmp_path, "pre\n" + "|".join(names) + f"\n{i}a|{i}b|{i}c|{i}d|{i}\n", f"f{i:02}.txt")
    out = read_delimited(spark, str(tmp_path), Delimited(skip_rows=1))
    assert len(out.columns) == 13 and [c for c in out.columns if c.lower() == "id"] == ["ID"]
    found = {r["ID"]: r.asDict() for r in out.collect()}
    assert len(found) == 12 and found["11"]["c11"] == "11a" and found["11"]["c2"] == "11d" and found["11"]["c5"] is None
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan text") == 1 and "Union" not in plan


def test_plain_csv_quotes(spark, rows, tmp_path):
    path = land(tmp_path, 'id|v\n1|"with| bar"\n2|\n')
    out = read_delimited(spark, path, Delimited(quote='"', escape="\\"))
    assert rows(out) == [("1", "with| bar"), ("2", None)]
    assert charset(" Latin1 ") == "ISO-8859-1" and charset("other") == "other"


def test_headers(spark):
    spec = TableDef(
        "t",
        (ColumnSpec("id", nullable=False, aliases=("key",)), ColumnSpec("name", canonical="Full Name"),
         ColumnSpec("note")),
    )
    assert header_mapping([" KEY", "full name ", "ID", "x"], spec) == {"id": " KEY", "name": "full name "}
    df = spark.createDataFrame([("1", "n")], "`KEY` string, `Full Name` string")
    out = resolve_headers(df, spec)
    assert [tuple(r) for r in out.collect()] == [("1", "n", None)]
    with pytest.raises(MissingColumns, match="id"):
        resolve_headers(df.drop("KEY"), spec)


def test_json_paths(spark, rows, tmp_path):
    path = land(tmp_path, '{"a": {"b": 1}, "c": "x"}\n{"a": {"b": 2}}\n', "f.json")
    assert rows(read_json(spark, path, {"b": "a.b", "c": "c"})) == [("1", "x"), ("2", None)]
    with pytest.raises(MissingPath, match="available: a, a.b, c"):
        read_json(spark, path, {"b": "a.z"})


def test_captures_are_validated():
    check_captures(r"^(\w+)_(\d+)\.csv$", {1: "feed", 2: "day"}, ["feed", "day"])
    for pattern, captures in ((r"(", {1: "x"}), (r"(a)", {2: "x"}), (r"(a)", {1: "nope"})):
        with pytest.raises(ValueError):
            check_captures(pattern, captures, ["x"])


def test_provenance_columns(spark, tmp_path):
    path = land(tmp_path, "id|v\n1|a\n")
    out = with_provenance(read_delimited(spark, path), version="7")
    assert out.columns[2:] == list(META_COLUMNS)
    row = out.first()
    assert row.meta_source_name == "f.txt" and row.meta_pipeline_version == "7"


def test_offsets_are_row_numbers_of_files_in_blocks(spark, small_blocks, tmp_path):
    land(tmp_path, "id|v\n" + "".join(f"{i}|a\n" for i in range(500)), "a.txt")
    land(tmp_path, "id|v\n" + "".join(f"{i}|{'b' * (i % 50)}\n" for i in range(300)), "b.txt")
    read = read_delimited(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 5
    found = with_provenance(read).select(F.col("id").cast("long"), "meta_source_offset", "meta_source_name").collect()
    assert len(found) == 800 and all(r[0] == r[1] for r in found)
    spark.range(0, 300, 1, 1).write.parquet(str(tmp_path / "p"))
    assert with_provenance(spark.read.parquet(str(tmp_path / "p"))).filter("id <> meta_source_offset").count() == 0


def test_jdbc_options_carry_no_secret(spark, monkeypatch):
    source = Jdbc("jdbc:x:y", table="t", user="u", password_env="TW_NO_SUCH", partition_column="id",
                  lower_bound=0, upper_bound=10, partitions=2, fetch_size=5)
    options = jdbc_options(source)
    assert options["numPartitions"] == "2" and options["fetchsize"] == "5" and "password" not in options
    monkeypatch.delenv("TW_NO_SUCH", raising=False)
    with pytest.raises(UnresolvedSecret):
        read_jdbc(spark, source)
    for bad in ({"table": "t", "query": "q"}, {}, {"query": "q", "partition_column": "id",
                "lower_bound": 0, "upper_bound": 1, "partitions": 2}, {"table": "t", "partitions": 3}):
        with pytest.raises(ValueError):
            Jdbc("jdbc:x", **bad)


def test_single_file_export(spark, tmp_path):
    df = spark.createDataFrame([(2, None), (1, "a|b")], "k int, v string")
    target = str(tmp_path / "out.csv")
    writers.write_single_file(writers.sorted_by_all(df), target, row_count_footer=True)
    assert (tmp_path / "out.csv").read_text() == 'k|v\n1|"a|b"\n2|\n2\n'
    assert not (tmp_path / "out.csv.parts").exists()
    assert writers.wants_footer("Disposition_x") and not writers.wants_footer("claims")


def test_identifiers():
    names = ["Member ID", "Inbound Only-Warm Transfer", "ICD9/10", "OutreachList", "123_column", "",
             "VAP_OutreachListPCP"]
    assert [identifier(n) for n in names] == [
        "member_id", "inbound_only_warm_transfer", "icd9_10", "outreach_list", "col_123_column",
        "unknown", "vap_outreach_list_pcp",
    ]


def test_text_schema_has_no_inference(spark, tmp_path):
    path = land(tmp_path, "a|b\n1|2\n")
    assert {f.dataType for f in read_delimited(spark, path).schema.fields} == {T.StringType()}
    assert read_delimited(spark, path).filter(F.col("a") == "1").count() == 1
