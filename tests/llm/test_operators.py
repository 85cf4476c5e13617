"""Every corpus operator on hard rows (nulls, empties, long texts, repeats, clashing columns) and against plain versions."""

import hashlib
import html
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import zstandard
from pyspark.sql import functions as F

from tidewright.llm import (
    chat_format,
    components,
    html_extract,
    language_id,
    line_dedup,
    ngram_join,
    piece_sampling,
    projection_ann,
    quality_rules,
    queries,
    source_mixing,
    suffix_dedup,
)
from tools.check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CLASH = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, score string, piece_ids string, size long, token long, label string"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set lambda_syntax = 'ENABLE_SINGLE_ARROW'")  # the twins' spelling, which DuckDB 2 refuses by default
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def hard(spark):
    rng = np.random.default_rng(3)
    base = [f"word{i}" for i in rng.integers(0, 400, 300)]
    near = base.copy()
    near[150] = "other"
    texts = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t\n ", None, None), (4, "one two", "en", "a"), (5, "One TWO", "en", "b"),
        (6, " ".join(base), "en", "a"), (7, " ".join(near), "en", "a"), (7, " ".join(near), "en", "a"), (None, " ".join(base), "de", None),
        (8, "x" * 300_000, "de", "b"), (9, "▁ é 日本語 \x00 <|im_end|>", "fr", "a"), (10, "same line\n" * 400, "fr", "b"),
        *[(20 + i, f"boiler plate line\nown text number {i} of this page here and there", "en", "a") for i in range(8)],
    ]
    return spark.createDataFrame([(*t, 0, "clash", "clash", "clash", 5, 6, "clash") for t in texts], CLASH).repartition(3)


@pytest.fixture(scope="module")
def nothing(hard):
    return hard.filter("false")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_twin(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    mine = [tuple(r) for r in found.collect()]
    cursor = duck.execute(queries.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(found.columns) == sorted(columns)
    assert rows_of(found.columns, mine) == rows_of(columns, cursor.fetchall())


# --- line deduplication


def test_lines_above_the_ratio_go(hard, nothing):
    out = line_dedup.drop_boilerplate_lines(hard)
    assert out.count() == hard.count() and set(out.columns) == {*hard.columns, "n_dropped"}
    rows = by_id(out)
    assert rows[20]["text"] == "own text number 0 of this page here and there" and (rows[20]["n_lines"], rows[20]["n_dropped"]) == (2, 1)
    assert rows[1]["text"] is None and rows[1]["n_lines"] == 0
    assert rows[2]["text"] == "" and rows[3]["text"] == " \n\t\n "
    assert rows[10]["n_dropped"] == 0, "one page repeats it, not the site"
    assert line_dedup.drop_boilerplate_lines(nothing).count() == 0


# --- n-gram join


def plain_classes(rows, percent=75):
    sets = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        sets.append(frozenset([tuple(words)] if 0 < len(words) < 5 else (tuple(words[i : i + 5]) for i in range(len(words) - 4))))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[find(i)] = find(j)
    first = {}
    for i, (doc, _) in enumerate(rows):
        first[find(i)] = min((d for d in (first.get(find(i)), doc) if d is not None), default=None)
    return sorted(((d, len(s), first[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def test_join_equals_all_pairs(spark, hard, nothing):
    assert ngram_join.link_documents(nothing).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(hard.select(F.col("doc_id") + 10_000, "text").toDF("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    found = ngram_join.link_documents(docs)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == plain_classes(rows)


def test_one_of_each_class_stays(hard):
    kept = ngram_join.keep_one_of_each(hard)
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert kept.columns == hard.columns
    assert 7 not in ids and {1, 2, 3, 4, 6, 8, 9, 10} <= set(ids) and 5 not in ids


def test_hot_shingles_are_salted_and_classes_stay_whole(spark, monkeypatch):
    """A family of near copies large enough that its shingles stand out: one class, linearly many pairs."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 5000, 400)]
    rows = []
    for i in range(300):
        words = base.copy()
        for k in rng.integers(0, 400, 3):
            words[k] = f"v{rng.integers(0, 9999)}"
        rows.append((i, " ".join(words)))
    found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["component_id"] for r in found.collect()} == {0}


def test_star_rounds_keep_every_class(spark, monkeypatch):
    """Near copies around one text, some too far from all others; rounds of stars, then the rest by pairs."""
    monkeypatch.setattr(ngram_join, "PAIRS_PER_SET", 2)
    crossing = []
    plain = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda p, *a: crossing.append(p.count()) or plain(p, *a))
    rng = np.random.default_rng(8)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    rows = []
    for i in range(80):
        words = base.copy()
        for k in rng.integers(0, 150, rng.integers(0, 7)):
            words[k] = f"v{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(words)))
    found = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    expected = plain_classes(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == expected
    assert len(crossing) > 2


def test_long_lists_meet_through_their_pivot(spark, monkeypatch):
    """A family with many members just too far from all others: the same classes from few of its pairs, at other thresholds too."""
    rng = np.random.default_rng(11)
    base = [f"w{i}" for i in rng.integers(0, 5000, 150)]
    rows = [(1000, " ".join(base[:75] * 2))]
    for i in range(300):
        words = base.copy()
        for k in rng.integers(0, 150, rng.integers(1, 8)):
            words[k] = f"v{rng.integers(0, 40 if i % 3 else 10**6)}"
        rows.append((i, " ".join(words[: 150 - i % 4])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    compared = []
    plain = ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda p, *a: compared.append(p.count()) or plain(p, *a))
    for percent, longest in ((75, 100), (60, 3)):
        monkeypatch.setattr(ngram_join, "LONG_LIST", longest)
        compared.clear()
        found = ngram_join.link_documents(docs, percent=percent)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found.collect()), key=repr) == plain_classes(rows, percent)
        assert sum(compared) < 12 * len(rows)


def test_join_tasks_hand_over_parts_of_a_batch():
    """A batch of 8 MB of text becomes rows in parts of a few MB, and sketches in packed blocks; nothing is lost."""
    rng = np.random.default_rng(3)
    texts = [None, "", "few words", *(" ".join(f"w{i}" for i in rng.integers(0, 10**6, 300)) for _ in range(4000))]
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts)], names=["doc_id", "digest", "text"])
    classes = SimpleNamespace(value=np.zeros(1 << ngram_join.SKETCH_BITS, np.uint8))
    plain = [ngram_join.shingles(t and t.encode()) for t in texts]

    def whole(batches, most=4 << 20):
        batches = list(batches)
        assert max(b.nbytes for b in batches) < most and len(batches) > 1
        return pa.Table.from_batches(batches)

    named = whole(ngram_join._name_sets(iter([batch])))
    documents = named.filter(pc.is_null(named["block"]))
    assert documents["doc_id"].to_pylist() == list(range(n)) and documents["n"].to_pylist() == [len(p) for p in plain]
    posted = whole(ngram_join._post(classes, 75)(iter([batch.select(["text"])])))
    assert posted.num_rows == sum(ngram_join.prefix_size(len(p)) for p in plain if len(p))
    sets = whole(ngram_join._sets(classes, 75)(iter([batch.select(["doc_id", "text"])])))
    assert sets["tokens"].to_pylist() == [ngram_join.signed(p).tolist() for p in plain]
    groups = pa.RecordBatch.from_arrays(
        [*[pa.array(range(n))] * 6, *[pa.array(x, pa.list_(pa.int64())) for x in (sets["tokens"].to_pylist(), [[i] for i in range(n)])]],
        names=["pivot", "pivot_n", "pivot_label", "set_id", "n", "label", "extra", "gone"],
    )
    differing = whole(ngram_join._differences(classes)(iter([groups])))
    assert differing["set_id"].to_pylist() == list(range(n))
    assert list(map(sorted, differing["differing"].to_pylist())) == [sorted([*ngram_join.signed(p).tolist(), i]) for i, p in enumerate(plain)]

    blocks = named.filter(pc.is_valid(named["block"])).select(["block", "counts"])
    common = np.zeros(ngram_join.SKETCH_BLOCK, np.uint32)
    common[7] = 300  # counts of another width
    more = pa.table({"block": pa.array([0], pa.int32()), "counts": [ngram_join.packed(common)]})
    summed = whole(ngram_join._sum_blocks(iter(pa.concat_tables([blocks, blocks, more]).combine_chunks().to_batches())), 1 << 20)
    expected = 2 * np.bincount(np.concatenate([ngram_join.cells(p) for p in plain]), minlength=1 << ngram_join.SKETCH_BITS)
    expected[7] += 300
    found = np.zeros_like(expected)
    for block, counts in zip(summed["block"].to_pylist(), summed["counts"].to_pylist(), strict=True):
        found[block * ngram_join.SKETCH_BLOCK : (block + 1) * ngram_join.SKETCH_BLOCK] = ngram_join.unpacked(counts)
    assert (found == expected).all()


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.connected(edges, "a", "b").collect()}
    assert found == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


HELPERS = ["__salt", "__s", "__k0", "__kept", "__flagged", "__host", "__digest", "__hash", "__id", "__key", "__times", "__copy", "__source"]


def test_columns_named_like_helpers_pass_through(spark):
    line = "a line that stands on every page of this host"
    words = " ".join(f"word{i}" for i in range(40))
    texts = [(i, f"{line}\n{words} number{i} " + " ".join(f"own{i}x{k}" for k in range(60)), "a") for i in range(12)] + [(20, "too short", "a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, source string")
    docs = docs.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in HELPERS])

    def same(out, ids):
        rows = by_id(out)
        assert set(rows) == set(ids) and all(rows[i][c] == f"{c}{i}" for i in rows for c in HELPERS)
        return rows

    rows = same(line_dedup.drop_boilerplate_lines(docs), [*range(12), 20])
    assert line not in rows[3]["text"] and rows[3]["n_dropped"] == 1
    same(quality_rules.keep_judged(docs), range(12))
    same(ngram_join.keep_one_of_each(docs.filter("doc_id < 3")), range(3))
    pages = docs.filter("doc_id < 3").withColumn("__html", F.concat(F.lit("__html"), "doc_id")).withColumnRenamed("text", "html")
    same(html_extract.extract_pages(pages), range(3))


# --- language


def test_languages_are_told_apart(spark, hard, nothing):
    out = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang", "text"), "doc_id"
    )
    rows = [r for r in out.collect() if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["lang_pred"] == r["lang"] for r in rows]) > 0.98 and all(0 <= r["score"] <= 1 for r in rows)
    learned = language_id.learn_dictionaries(hard)
    assert set(learned) <= {"en", "de", "fr"}
    rows = by_id(language_id.identify(hard, learned))
    assert (rows[1]["lang_pred"], rows[2]["lang_pred"], rows[3]["lang_pred"]) == ("und",) * 3 and rows[1]["score"] == 0
    assert rows[6]["lang_pred"] in learned and rows[8]["lang_pred"] in learned
    assert language_id.learn_dictionaries(nothing) == {}
    assert {r["lang_pred"] for r in language_id.identify(hard, {}).collect()} == {"und"}
    assert language_id.identify(nothing, learned).count() == 0
    only = language_id.identify(hard, {"en": learned["en"]}).filter("doc_id = 6").first()
    assert (only["lang_pred"], only["score"], only["confident"]) == ("en", 0.0, False)


def test_copies_do_not_fill_the_sample(spark):
    rows = [("en", t) for k in range(20) for t in [f"text {chr(97 + k) * 5} of its own"] * 5]
    learned = language_id.learn_dictionaries(spark.createDataFrame(rows, "lang string, text string"), sample_rows=10)
    assert learned["en"].count(b"of its own") == 10


def test_letters_are_letters_and_keep_their_marks(spark, hard):
    learned = language_id.learn_dictionaries(hard)
    odd = spark.createDataFrame([(1, "½ ²"), (2, "12 ٣ ²"), (3, "a½"), (4, "__")], "doc_id long, text string")
    rows = by_id(language_id.identify(odd, learned))
    assert [rows[i]["lang_pred"] == "und" for i in (1, 2, 3, 4)] == [True, True, False, True]
    assert language_id.letters("हिन्दी में 12²") == "हिन्दी में"


def test_prediction_equals_plain_compression(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text").orderBy("doc_id").limit(300)
    learned = language_id.learn_dictionaries(docs)
    assert list(learned) == sorted(learned) and len(learned) > 1
    options = zstandard.ZstdCompressionParameters.from_level(
        language_id.LEVEL, window_log=17, hash_log=17, chain_log=16, search_log=2, min_match=3, strategy=zstandard.STRATEGY_LAZY,
        write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    found = by_id(language_id.identify(docs, learned))
    for r in docs.collect():
        words = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (r["text"] or "").lower()).split()
        data = " ".join(words).encode() + b" "
        if not any(c.isalpha() for c in r["text"] or ""):
            assert found[r["doc_id"]]["lang_pred"] == "und"
            continue
        while len(data) < language_id.SHORT_BYTES:
            data = (" ".join(words).encode() + b" ") * (len(data) // (len(" ".join(words).encode()) + 1) + 1)
        sizes = {}
        for lang, content in learned.items():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=options)
            one = zstandard.ZstdCompressor(dict_data=held, compression_params=options)
            sizes[lang] = sum(len(one.compress(data[i : i + language_id.CHUNK_BYTES])) for i in range(0, len(data), language_id.CHUNK_BYTES))
        first, second = sorted(sizes.items(), key=lambda x: (x[1], x[0]))[:2]
        assert (found[r["doc_id"]]["lang_pred"], found[r["doc_id"]]["score"]) == (first[0], 1 - first[1] / second[1])


# --- repeated passages


def plain_cuts(rows, length=200):
    seen = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for d, t in rows:
        spans = suffix_dedup.merged([(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        kept = suffix_dedup.cut_out(t, spans)
        out.append((d, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_ROWS, 2])
def test_repeats_equal_every_string_counted(spark, hard, nothing, hot):
    assert suffix_dedup.cut_digests(suffix_dedup.repeated_spans(nothing)).count() == 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    ring = "".join(chr(97 + i * i % 26) for i in range(230))
    made = [(50_000, ring * 3), (50_001, "q" + ring[:199]), (50_002, "z" + ring[:200] + "z"), (50_003, "é" * 250), (50_004, "ab" * 101)]
    made += [(None, "lone " * 60), (50_005, None)]
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string")).unionByName(
        hard.filter("doc_id <> 8").select(F.col("doc_id") + 60_000, "text").toDF("doc_id", "text")
    )
    rows = [(r[0], (r[1] or "").encode()) for r in docs.collect()]
    found = suffix_dedup.cut_digests(suffix_dedup.repeated_spans(docs, hot_rows=hot))
    assert sorted((tuple(r) for r in found.collect()), key=repr) == plain_cuts(rows)


def test_long_texts_are_cut_into_segments(monkeypatch):
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 100, 5000, dtype=np.uint8))
    whole = {(int(f) + k, int(a)) for at, p in suffix_dedup.segments(text) for f, n, a in zip(*suffix_dedup.anchored_runs(p), strict=True) for k in range(n)}
    parts = {(at + int(f) + k, int(a)) for at, p in suffix_dedup.segments(text, segment=700) for f, n, a in zip(*suffix_dedup.anchored_runs(p), strict=True) for k in range(n)}
    assert whole == parts and len(whole) == 5000 - 199


# --- chat


def test_chat_comes_back_from_the_rendered_text(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    turns = [
        (1, 0, "user", hard), (1, 1, "assistant", hard), (2, 0, "us\ner", None), (2, 1, "assistant", "<\\|im_end|> \\ <|nl|>"), (2, 1, "assistant", "again"),
        (None, 0, None, "x"), (3, None, "assistant", ""), (3, 5, "assistant", "<|im_end"), (4, 0, "assistant", "y" * 300_000),
    ]
    rows = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    found = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(rows)).collect()}
    plain = defaultdict(list)
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        plain[conv].append((role or "", text or ""))
    assert set(found) == set(plain)
    for conv, said in plain.items():
        loss = "".join(x for r, x in said if r == "assistant")
        want = (len(said), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want
    assert chat_format.format_conversations(rows.filter("false")).count() == 0
    text, spans = chat_format.render([("user", "plain"), ("assistant", "<|x")])
    assert "\\" not in text and [text[a:b] for a, b in spans] == ["<|x"], "only conflicting content is escaped"


# --- pages


def test_main_text_equals_the_article(spark):
    found = {r["page_id"]: r for r in queries.op6_html_extract(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(found) == len(pages)
    for page in pages:
        inner = re.search(r"<article>(.*?)(</article>|$)", page["html"], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>|<br>", inner))
        assert found[page["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert found[page["page_id"]]["n_chars"] == len(found[page["page_id"]]["text"])


def test_main_text_of_odd_pages(spark):
    cases = {
        None: "", "": "", "plain &lt; text": "plain < text", "<p>cut <a href='x": "cut", "<script>var x='</p><p>no</p>'</script><p>ok</p>": "ok",
        "<nav><ul><li>a</li></ul><article><header><h1>Title</h1><p>by x</p></header><p>one<p>two <b>bold</b><section class=comments><p>c</p></section>"
        "<aside>s</aside><p>last &amp;\n end</p></article><form>f</form><footer>z": "Title\none\ntwo bold\nlast & end",
        "<div class='sidebar'><p>links</p></div><div><p>The text of this page</p></div><div id=cookie-notice>c</div>": "The text of this page",
    }
    rows = spark.createDataFrame([(i, h, "clash") for i, h in enumerate(cases)], "page_id long, html string, text string")
    found = {r["page_id"]: r["text"] for r in html_extract.extract_pages(rows).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert html_extract.extract_pages(rows.filter("false")).count() == 0


LONG = "This is a long paragraph of the article with a good many words in it, so that its ratio is high. " * 3
LONG = LONG.strip()


@pytest.mark.parametrize(("page", "expected"), [
    (f"<body><div class='content no-sidebar'><h1>T</h1><p>{LONG}</p><p>short</p></div><div class=sidebar><p>side</p></div></body>", f"T\n{LONG}\nshort"),
    (f"<body><nav>x</nav><div>one</div><div>two b</div><div>three</div><div>four d</div><div>{LONG}</div></body>", f"one\ntwo b\nthree\nfour d\n{LONG}"),
    (f"<main><h1>T</h1><article><p>{LONG}</p></article><article><p>tiny note</p></article></main><p>out</p>", f"T\n{LONG}\ntiny note"),
    (f"<article><p>{LONG}</p><p class='social-history'>He was well.</p><p class=ad>Buy.</p></article>", f"{LONG}\nHe was well."),
    (f"<body><ul><li><a href=a>A long entry of a menu, long as it can be</a></li><li><a href=b>Another long entry of that menu</a></li></ul>"
     f"<div class=post><h1>Title</h1><ul><li>a</li><li>b</li></ul><p>{LONG}</p></div></body>", f"Title\na\nb\n{LONG}"),
    (f"<body><div><a href=a>A long entry of a menu, long as it can be</a></div><div>{LONG}</div><div><a href=b>Another entry</a></div></body>", LONG),
    (f"<body><div class='widget-body'><p>{LONG}</p><p>{LONG}</p></div><div>hi</div></body>", f"{LONG}\n{LONG}"),
    (f"<body><div class=post><p>short one of it</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p></div></body>", "short one of it"),
    (f"<body><div id=content><h1>T</h1><div class=text><p>{LONG}</p></div></div><div>Copyright</div></body>", f"T\n{LONG}"),
])
def test_density_and_growth_select_the_content(page, expected):
    assert html_extract.main_text(page) == expected


def test_smoothing_and_threshold_decide():
    page = f"<body><div class=a><p>{LONG}</p></div><div class=b>in the middle of it</div><div class=c><p>{LONG}</p></div><div class=d><ul>" + (
        "<li>x y</li>" * 12
    ) + "</ul></div></body>"
    alone = f"<body><div class=a>{LONG}</div><p><b>Near</b> it</p><div class=d><ul>{'<li>x y</li>' * 12}</ul></div></body>"
    assert html_extract.main_text(page) == f"{LONG}\nin the middle of it\n{LONG}"
    assert "Near it" in html_extract.main_text(alone) and "x y" not in html_extract.main_text(alone)
    assert "Near it" not in html_extract.main_text(alone, radius=0)
    assert "x y" in html_extract.main_text(alone, level=0.0)


def test_long_and_deep_pages_are_read_whole():
    whole = html_extract.main_text("<article>" + "<p>some words of text</p>" * 50_000)
    assert whole.count("\n") == 49_999 and len(html_extract.main_text("<div>" * 20_000 + "deep")) == 4


# --- quality


def test_quality_rules_on_hard_rows(hard, nothing):
    out = quality_rules.judge_documents(hard)
    assert out.count() == hard.count()
    rows = by_id(out)
    assert rows[1]["n_words"] == 0 and rows[1]["base_failed"] and not rows[1]["kept"]
    assert rows[10]["n_dup_lines"] == 399 and rows[10]["base_failed"]
    assert rows[6]["kept"] and rows[6]["n_words"] == 300 and rows[9]["n_symbols"] == 4
    kept = quality_rules.keep_judged(hard)
    assert kept.columns == hard.columns and sorted(r["doc_id"] for r in kept.filter("doc_id < 20").collect()) == [6, 7, 7]
    assert quality_rules.judge_documents(nothing).count() == 0 and quality_rules.keep_judged(nothing).count() == 0


def test_depleted_documents_go(spark):
    line = "this very line stands on every page of the host and says nothing at all"
    other = "some rather different words number {} that only this one page has to tell its readers {} {}"
    rows = [(i, f"{line}\n{line} {i}" if i == 0 else f"{line}\n" + other.format(i, i * 7, i * 11), "h") for i in range(30)]
    rows += [(100, line + "\nyes", "h")]
    judged = by_id(quality_rules.judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert not judged[100]["kept"] and not judged[100]["base_failed"] and judged[5]["kept"] and judged[5]["n_removed_words"] == 15


# --- neighbours


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(2)
    data = rng.standard_normal((3000, 16))
    data[::7] = data[0]
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    odd = [(10_000, None), (10_100, [0.0] * 16), (10_200, [float("nan")] * 16), (10_300, [None] * 16), (10_400, [1.0, 2.0]), (None, [1.0] * 16)]
    table = spark.createDataFrame([(*r, "clash") for r in rows + odd], "vec_id long, embedding array<double>, score string")
    found = defaultdict(list)
    for r in projection_ann.nearest(table, block_rows=200, chunk_rows=10).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((data - data[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        got = sorted(found.pop(q))
        assert [g[0] for g in got] == list(range(1, 11)) and all(abs(s - d[i]) < 1e-9 for _, i, s in got)
        hits += len({i for _, i, _ in got} & set(np.lexsort((np.arange(3000), d))[:10].tolist()))
    assert not found and hits >= 0.9 * 300
    few = projection_ann.nearest(table.filter("vec_id < 4"))
    assert [(r["rank"], r["vec_id"]) for r in few.orderBy("rank").collect()][0][0] == 1 and few.count() == 3
    assert projection_ann.nearest(table.filter("false")).count() == 0
    assert abs(projection_ann.chi_square_quantile(0.95, 8) - 15.507313) < 1e-5


def test_ties_of_equal_vectors_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((3000, 16))
    copies = rng.permutation(3000)[:2000]
    data[copies] = data[copies[0]]
    smallest = sorted(copies.tolist())
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    for parts in (3, 5):
        found = defaultdict(list)
        for r in projection_ann.nearest(table.repartition(parts)).collect():
            found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        for q in {*range(0, 3000, 100)} & set(smallest):
            expected = [i for i in smallest if i != q][:10]
            assert sorted(found[q]) == [(n + 1, i, 0.0) for n, i in enumerate(expected)]


def test_copied_rows_follow_the_visits(spark, monkeypatch):
    """Each visited block goes once to every chunk of its own visitors; searching the home cells so is linear in the rows."""
    seen = []
    plain_chunks, plain_copies = projection_ann.chunks_of, projection_ann.copies_of

    def chunks_of(asked, chunk_rows):
        seen.append([asked.count()])
        return plain_chunks(asked, chunk_rows)

    def copies_of(blocks, chunks):
        out = plain_copies(blocks, chunks)
        seen[-1] += [out.count(), chunks.count(), blocks.groupBy("block").count().agg(F.max("count")).first()[0]]
        return out

    monkeypatch.setattr(projection_ann, "chunks_of", chunks_of)
    monkeypatch.setattr(projection_ann, "copies_of", copies_of)
    rng = np.random.default_rng(8)
    home = []
    for n in (2000, 4000, 8000):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 8)))], "vec_id long, embedding array<double>")
        seen.clear()
        assert projection_ann.nearest(table, "vec_id % 10 = 0", block_rows=100, chunk_rows=4).count() == n // 10 * 10
        for visits, copied, blocks, largest in seen:
            assert copied <= largest * (visits / 4 + blocks)
        home.append(seen[0][1])
    assert home[1] < 2.5 * home[0] and home[2] < 2.5 * home[1]


def test_repeated_vectors_and_ids_are_ranked_exactly(spark):
    same = [float(x) for x in range(1, 5)]
    rows = [(i, same) for i in range(40)] + [(0, same)] * 30 + [(1, same)] * 3 + [(100, [9.0, 9.0, 9.0, 9.0])] * 2
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in projection_ann.nearest(table, k=3).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"]))
    assert {q: sorted(f) for q, f in found.items()} == {0: [(1, 1), (2, 1), (3, 1)], 100: [(1, 0), (2, 0), (3, 0)]}
    assert projection_ann.returnable(table.select("vec_id", F.col("embedding").alias("vector")), 3).count() == 3 + 3 + 2 + 2


# --- mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(sizes.values())
    free = set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if weight[s] * level >= 2 * sizes[s]}
        if not above:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in above}
        left -= sum(2 * sizes[s] for s in above)
        free -= above
    return target


def test_mix_comes_near_its_targets(spark, hard, nothing):
    for docs in (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), hard):
        rows = source_mixing.mix_sources(docs).collect()
        again = source_mixing.mix_sources(docs.repartition(5)).collect()
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, again), key=repr) and len(rows) == docs.count()
        sizes, taken = Counter(), Counter()
        for r in rows:
            sizes[r["source"]] += r["size"]
            taken[r["source"]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"]
        for s, target in plain_targets(sizes).items():
            assert all(abs(r["target"] - target) < 1e-6 * max(1, target) and r["source_size"] == sizes[s] for r in rows if r["source"] == s)
            assert abs(taken[s] - target) <= 2 * source_mixing.BLOCK_WORDS
    assert source_mixing.mix_sources(nothing).count() == 0


def test_highest_quotients(spark):
    votes = {"a": 53000, "b": 24000, "c": 23000, "d": 0, "e": 1}
    table = spark.createDataFrame([(k, float(v), 17) for k, v in votes.items()], "k string, v double, seats long")
    found = {r["k"]: r["won"] for r in source_mixing.highest_quotients(table, [], ["k"], "v", "seats", "won").collect()}
    won = Counter()
    for _ in range(17):
        won[max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), -ord(k)))] += 1
    assert found == {k: won[k] for k in votes}


# --- pieces


def test_pieces_decode_and_do_not_depend_on_batches(spark, hard, nothing):
    out = piece_sampling.sample_pieces(hard, verify="lossless")
    assert out.columns == [*[c for c in hard.columns if c != "piece_ids"], "piece_ids", "lossless"]
    rows = out.collect()
    assert len(rows) == hard.count() and all(r["lossless"] for r in rows)
    ids = {r["doc_id"]: r["piece_ids"] for r in rows}
    assert ids[1] is None and ids[2] == [] and piece_sampling.sample_pieces(nothing).count() == 0
    pieces = piece_sampling.Pieces(open(piece_sampling.MODEL_PATH, "rb").read())
    for doc in (4, 6, 9):
        text = hard.filter(F.col("doc_id") == doc).first()["text"]
        assert piece_sampling.sample_texts(pieces, [text], [doc], block_bytes=64)[0].tolist() == ids[doc]
        assert piece_sampling.decode_ids(pieces, ids[doc]) == text


def test_sampled_shares_follow_the_weights():
    """Frequencies of sampled segmentations of one word against their exact probabilities."""
    pieces = piece_sampling.Pieces(open(piece_sampling.MODEL_PATH, "rb").read(), 0.3)
    word = b" the"
    by_text = {}
    for i, s in enumerate(pieces.spelled):
        if s and i not in pieces.byte_ids:
            by_text.setdefault(s, i)

    def ways(at):
        if at == len(word):
            yield (), 0.0
        for end in range(at + 1, len(word) + 1):
            if word[at:end] in by_text:
                for rest, log in ways(end):
                    yield (by_text[word[at:end]], *rest), pieces.log[by_text[word[at:end]]] + log

    exact = {w: np.exp(log) for w, log in ways(0)}
    total = sum(exact.values())
    n = 20_000
    with np.errstate(over="ignore"):
        ids, number = piece_sampling.sample_block(pieces, [word] * n, np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ends = np.cumsum(number)
    seen = Counter(tuple(ids[e - k : e].tolist()) for e, k in zip(ends, number, strict=True))
    assert set(seen) <= set(exact)
    for w, p in exact.items():
        assert abs(seen[w] / n - p / total) < 4 * np.sqrt(p / total / n) + 1e-3


@pytest.mark.parametrize("name", ["op1_line_dedup", "op9_source_mixing"])
def test_native_operators_run_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan
