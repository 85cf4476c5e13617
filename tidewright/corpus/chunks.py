"""Documents to chunks: markup removed, overlapping word windows, stable identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words per chunk and words shared by neighbouring chunks.
CHUNK_WORDS = 300
CHUNK_OVERLAP = 30


# The characters that separate words, beyond the space.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK_RUN = "[ " + BLANKS + "]+"


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(" " + BLANKS))


def html_to_text(c: Column) -> Column:
    """Tags become spaces, white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", " "), BLANK_RUN, " "))


def words(c: Column) -> Column:
    """The words of a text; a blank text has none."""
    text = stripped(c)
    return F.when(text != "", F.split(text, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def chunk_documents(
    df: DataFrame,
    key: str,
    text: str,
    words_per_chunk: int = CHUNK_WORDS,
    overlap: int = CHUNK_OVERLAP,
) -> DataFrame:
    """One row per window of the whole text.

    The rows are produced inside each document's own task: no shuffle.
    """
    step = max(1, words_per_chunk - overlap)
    split = df.filter(stripped(F.col(text)) != "").select(key, words(F.col(text)).alias("_w"))
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(step))
    # no array is empty here; the outer form keeps Spark from adding a filter on the array's size,
    # which would split the text again for every window
    windows = split.select(
        key, F.posexplode_outer(F.transform(starts, lambda s: F.slice("_w", s + 1, words_per_chunk)))
    )
    return windows.select(
        key,
        chunk_id(F.col(key), F.col("pos")).alias("chunk_id"),
        F.col("pos").alias("chunk_index"),
        F.array_join("col", " ").alias("text"),
        F.size("col").alias("word_count"),
    )


def chunk_id(key: Column, index: Column) -> Column:
    return F.format_string("%s:%04d", key.cast("string"), index)


def unit_vector(seed_text: Column, dimension: int, digits: int = 8) -> Column:
    """A reproducible vector of length one whose elements depend only on the text.

    The text is hashed once; the elements are hashes of consecutive numbers from there.
    """
    if dimension < 1:
        raise ValueError("dimension must be at least 1")
    span = 2**53
    first = F.pmod(F.xxhash64(seed_text, F.lit(dimension)), F.lit(2**50))
    raw = F.transform(
        F.sequence(first, first + dimension - 1),
        lambda i: F.pmod(F.xxhash64(i), F.lit(span)) * (2.0 / span) - 1.0,
    )
    return _normalised(raw, digits)


def _normalised(values: Column, digits: int) -> Column:
    """The vector is bound once as the accumulator's first part, its norm is added to it."""
    pair = F.transform(
        F.array(values),
        lambda v: F.struct(
            v.alias("v"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)).alias("n")
        ),
    )
    return F.flatten(
        F.transform(
            pair,
            lambda p: F.transform(p["v"], lambda x: F.round(x / p["n"], digits).cast("float")),
        )
    )
