"""Language identification by compression.

Each language has a raw-content zstandard dictionary made of a bounded sample of its labelled texts
(``sample_rows`` different texts of at most ``sample_chars`` characters each, in the order of a hash of the text, joined
up to ``dictionary_bytes``). Whole texts, in lower case and with all but letters and their marks turned into single
spaces, are encoded with every dictionary in chunks of ``chunk_bytes``; a text under ``SHORT_BYTES`` is repeated up to
that length first, or the encoder would store it as it is. The language with the smallest total wins, ties going to
the first in code-point order. The score is the relative margin 1 - best / second; below ``least_margin`` the operator
rejects the answer (``confident`` is false).

Defined results: a null text and a text without letters get ``und``, score 0, not confident; with no labelled
text at all every row gets ``und``; with one language its score is 0; a null id is never held out and never
learned from; repeated rows get the same answer; an empty table gives an empty table.

The fit brings at most sample_rows * sample_chars characters per language to the driver, whatever the size of
the corpus; only hashes of the texts are shuffled to choose them. Prediction is one pass without a shuffle; the
dictionaries are the only state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE_ROWS = 256
SAMPLE_CHARS = 4000
DICTIONARY_BYTES = 48 * 1024
CHUNK_BYTES = 4096
LEVEL = 3
LEAST_MARGIN = 0.01
SHORT_BYTES = 512
#: hashes over which the texts of a language are ranked before they are ranked together
SAMPLE_SALTS = 64
LETTER = regex.compile(r"\p{L}")
OTHERS = regex.compile(r"[^\p{L}\p{M}]+")


def learn_dictionaries(
    labelled: DataFrame, lang: str = "lang", text: str = "text", sample_rows: int = SAMPLE_ROWS,
    sample_chars: int = SAMPLE_CHARS, dictionary_bytes: int = DICTIONARY_BYTES,
) -> dict[str, bytes]:
    """Language -> dictionary content, from a bounded sample of the labelled rows."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).alias("lang"), F.substring(text, 1, sample_chars).alias("text"), F.xxhash64(text).alias("place")
    )
    # first within salts, so that one task ranks at most SAMPLE_SALTS * sample_rows hashes of a language
    places = rows.select("lang", "place").distinct().withColumn("salt", F.pmod("place", F.lit(SAMPLE_SALTS)))
    places = places.withColumn("nth", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("place"))).filter(F.col("nth") <= sample_rows)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = places.select("lang", "place").withColumn("nth", nth).filter(F.col("nth") <= sample_rows)
    # as few rows as the sample that is collected; whole copies are one text
    texts = rows.join(F.broadcast(chosen), ["lang", "place"]).groupBy("lang", "nth").agg(F.min("text").alias("text"))
    sample: dict[str, dict[str, None]] = {}
    for r in texts.orderBy("lang", "nth").collect():
        sample.setdefault(r["lang"], {})[letters(r["text"])] = None
    # what stands last is nearest to the text and cheapest to refer to; all that fits is used
    return {k: " ".join(v).encode()[:dictionary_bytes] for k, v in sorted(sample.items())}


def letters(text: str) -> str:
    return OTHERS.sub(" ", text.lower()).strip()


class Classifier:
    """Compressors of all languages; made once per task."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL, chunk_bytes: int = CHUNK_BYTES):
        self.chunk_bytes = chunk_bytes
        self.languages = list(dictionaries)
        self.compressors = []
        for content in dictionaries.values():
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            options = zstandard.ZstdCompressionParameters.from_level(
                level, window_log=17, hash_log=17, chain_log=16, search_log=2, min_match=3, strategy=zstandard.STRATEGY_LAZY,
                write_content_size=0, write_checksum=0, write_dict_id=0,
            )
            held.precompute_compress(compression_params=options)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=held, compression_params=options))

    def sizes(self, text: str) -> list[int]:
        data = letters(text).encode() + b" "
        if len(data) < SHORT_BYTES:
            data *= -(-SHORT_BYTES // len(data))
        chunks = [data[i : i + self.chunk_bytes] for i in range(0, len(data), self.chunk_bytes)]
        return [sum(len(c.compress(chunk)) for chunk in chunks) for c in self.compressors]

    def classify(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        others = [s for k, s in enumerate(sizes) if k != best]
        return self.languages[best], 1 - sizes[best] / min(others) if others else 0.0


def identify(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", least_margin: float = LEAST_MARGIN) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``confident``; columns of these names are replaced."""
    rest = docs.drop("lang_pred", "score", "confident")
    schema = rest.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("confident")).schema
    place = rest.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = Classifier(dictionaries)
        for batch in batches:
            found = [classifier.classify(t) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 pa.array([f[0] != "und" and f[1] >= least_margin for f in found], pa.bool_())],
                names=schema.names,
            )

    return rest.mapInArrow(predict, schema)


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the fold that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))
