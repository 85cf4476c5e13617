"""Chunks and vectors of documents and pages."""

from pyspark.sql import functions as F

from tidewright.corpus.chunks import chunk_documents, html_to_text, unit_vector
from tidewright.queries import query

BLANK = (
    r"[ \t\n\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
WORDS_SQL = (
    f"string_split_regex(regexp_replace({{c}}, '^{BLANK}+|{BLANK}+$', '', 'g'), '{BLANK}+')".replace(
        "{", "{{").replace("}", "}}").replace("{{c}}", "{c}")
)


def chunk_sql(source: str, key: str, size: int = 300, step: int = 270) -> str:
    return f"""select {key}, {key} || ':' || lpad(cast(i // {step} as varchar), 4, '0') as chunk_id,
          cast(i // {step} as int) as chunk_index, array_to_string(w[i + 1 : i + {size}], ' ') as text,
          cast(len(w[i + 1 : i + {size}]) as int) as word_count
        from (select {key}, w, unnest(range(0, len(w), {step})) as i from ({source}))"""


@query(
    "corpus_chunks",
    "EMB-02 EMB-03",
    chunk_sql(
        f"select doc_id, {WORDS_SQL.format(c='text')} as w from documents "
        + f"where regexp_replace(text, '{BLANK}+', '', 'g') <> ''",
        "doc_id",
    ),
)
def corpus_chunks(t):
    return chunk_documents(t.documents, "doc_id", "text")


PAGE_TEXT = f"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{BLANK}+', ' ', 'g'))"


@query("page_text", "EMB-01", f"select page_id, {PAGE_TEXT} as text from pages")
def page_text(t):
    return t.pages.select("page_id", html_to_text(F.col("html")).alias("text"))


@query(
    "page_chunks",
    "EMB-01 EMB-02 EMB-03",
    chunk_sql(
        f"select page_id, string_split({PAGE_TEXT}, ' ') as w from pages where {PAGE_TEXT} <> ''",
        "page_id",
        50,
        40,
    ),
)
def page_chunks(t):
    text = t.pages.select("page_id", html_to_text(F.col("html")).alias("text"))
    return chunk_documents(text, "page_id", "text", words_per_chunk=50, overlap=10)


@query(
    "corpus_unit_vectors",
    "EMB-04",
    """select count(*) as chunk_count, count(*) as unit_vectors, count(distinct text) as texts,
         count(distinct text) as distinct_vectors from documents""",
)
def corpus_unit_vectors(t):
    rows = t.documents.select("text", unit_vector(F.col("text"), 32).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    per_text = rows.select("text", F.xxhash64("v").alias("h"), (F.abs(length - 1) < 1e-6).alias("ok"))
    per_text = per_text.groupBy("text").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("ok"), F.min("h").alias("h"),
        F.max("h").alias("h2"),
    )
    # texts with one vector each, counted by vector
    return per_text.groupBy("h").agg(
        F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.count_if(F.col("h") == F.col("h2")).alias("texts")
    ).agg(
        F.sum("n").alias("chunk_count"),
        F.sum("ok").alias("unit_vectors"),
        F.sum("texts").alias("texts"),
        F.count(F.lit(1)).alias("distinct_vectors"),
    )


@query("corpus_vectors", "EMB-04")
def corpus_vectors(t):
    chunks = chunk_documents(t.documents, "doc_id", "text")
    return chunks.select("chunk_id", unit_vector(F.col("text"), 32).alias("embedding"))
