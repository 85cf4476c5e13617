"""Sampled SentencePiece segmentations by forward filtering and backward sampling; decoding is lossless.

A text gets a space in front and its spaces stand for the pieces' word marks (U+2581). Its lattice has an edge for
every piece that matches, and byte pieces for characters that no piece spells. Forward filtering sums the weights
of all segmentations that end at a position; backward sampling draws the last piece in proportion to them, then
the piece before, and so on: an exact draw from P(segmentation) ~ product of piece weights. The weight of a
piece of merge rank r is (1 / (H * (1 + r))) ** alpha (Zipf's law; H normalises), so alpha 0 is uniform and large
alpha the likeliest segmentation. Draws are counter-based: a function of seed, row key, word and step, so retries,
batch sizes and partitions do not change them.

No piece crosses from a non-space to a space or holds a line break, so the lattice falls into words; equal
words of a block share one forward pass, and a block's words are drawn together with numpy.

A literal U+2581 is spelled in bytes, which keeps decoding exact. Defined results: a null text has null ids (an
empty text has none); a null key is a key; repeated rows get equal ids; an empty table gives an empty table; other
columns pass through, one named ``piece_ids`` is replaced.

One pass over Arrow batches without a shuffle. Blocks hold about ``BLOCK_BYTES`` of text; longer texts are cut between
words into several blocks, so memory does not follow the longest text's lattice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = "pieces-1"
BLOCK_BYTES = 1 << 20
LONG_WORD = 64
MARK = "▁"
WORDS = re.compile(rb" *[^ \n]+|\n| +")
#: bytes of the character that a byte begins; continuation bytes begin none
CHAR_BYTES = np.array([1 if b < 0x80 else 0 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4 for b in range(256)])
STEP = np.uint64(0x9E3779B97F4A7C15)
WORD_STEP = np.uint64(0xD1B54A32D192ED03)


class Pieces:
    """Trie, weights and spelling of the vocabulary."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        import sentencepiece

        spm = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.spelled: list[bytes] = [b""] * len(spm)
        self.byte_ids = np.zeros(256, np.int32)
        children: list[dict[int, int]] = [{}]
        ends: dict[int, int] = {}
        rank = np.zeros(len(spm))
        for i in range(len(spm)):
            name = spm.id_to_piece(i)
            if spm.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value], self.spelled[i] = i, bytes([value])
            elif not (spm.is_control(i) or spm.is_unknown(i) or spm.is_unused(i)):
                self.spelled[i], rank[i] = name.replace(MARK, " ").encode(), -spm.get_score(i)
                inner = self.spelled[i].lstrip(b" ")
                if b" " in inner or b"\n" in self.spelled[i]:
                    raise ValueError(f"piece {name!r} crosses a word: this vocabulary does not fall into words")
                node = 0
                for b in self.spelled[i]:
                    if b not in children[node]:
                        children[node][b] = len(children)
                        children.append({})
                    node = children[node][b]
                ends[node] = i
        self.nodes = len(children)
        self.steps = np.array([(node, b, to) for node, follow in enumerate(children) for b, to in follow.items()], np.int32).T
        self.piece = np.full(len(children), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, self.spelled))
        if len(spm) > 1 << 15 or self.longest > 63:
            raise ValueError("the packed lattice takes at most 32768 pieces of at most 63 bytes")
        total = sum(1 / (1 + rank[i]) for i in ends.values())
        self.log = -alpha * (np.log1p(rank) + np.log(total))
        self.log[self.byte_ids] = -alpha * (np.log(len(spm)) + np.log(total))
        # a factor per byte keeps products of short words near 1; it cancels out
        self.weight = np.exp(self.log + alpha * 3.0 * np.array([len(s) for s in self.spelled]))
        self.spread()

    def spread(self) -> None:
        """The dense transition table; tasks rebuild it from the list of steps, which is a hundredth of its size."""
        self.next = np.zeros((self.nodes, 256), np.int32)
        self.next[self.steps[0], self.steps[1]] = self.steps[2]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "next"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.spread()

    def edges(self, data: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of all matches in ``data`` that end at ``stop`` of their word or before."""
        found = []
        at = np.arange(len(data))
        node = np.zeros(len(data), np.int32)
        spelled = np.zeros(len(data), bool)
        for k in range(self.longest):
            inside = at + k < stop[at]
            at, node = at[inside], node[inside]
            node = self.next[node, data[at + k]]
            alive = node > 0
            at, node = at[alive], node[alive]
            if not len(at):
                break
            piece = self.piece[node]
            hit = piece >= 0
            found.append((at[hit], np.full(np.count_nonzero(hit), k + 1), piece[hit]))
            spelled[at[hit & (CHAR_BYTES[data[at]] == k + 1)]] = True
        first = CHAR_BYTES[data] > 0
        owner = np.maximum.accumulate(np.where(first, np.arange(len(data)), 0))
        raw = np.flatnonzero(~spelled[owner])
        found.append((raw, np.ones(len(raw), np.int64), self.byte_ids[data[raw]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on key and step alone (splitmix64)."""
    x = key + np.uint64((int(STEP) * (step + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) * 2.0**-53


def lattice(pieces: Pieces, words: list[bytes]):
    """Forward filtering of distinct words: edges in order, with their running share of the edges into their node.

    Words over LONG_WORD bytes get their shares from long_shares: their products would leave the range of doubles.
    """
    lengths = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    first = np.cumsum(lengths) - lengths
    stop = np.repeat(first + lengths, lengths)
    start, size, piece = pieces.edges(data, stop)
    # node of a word's prefix of k bytes: first + word + k, so every word has one node more than bytes
    word = np.repeat(np.arange(len(words)), lengths)
    head = start + word[start] + size
    depth = np.minimum(start + size - first[word[start]], LONG_WORD + 1)
    # one number per edge, in the order of the pass: depth, node, length, piece
    packed = np.sort((depth << 53) | (head << 21) | (size << 15) | piece)
    depth, head, piece = packed >> 53, (packed >> 21) & 0xFFFFFFFF, packed & 0x7FFF
    tail = head - ((packed >> 15) & 0x3F)
    fresh = np.flatnonzero(np.r_[True, head[1:] != head[:-1]][: len(head)])
    counts = np.diff(np.r_[fresh, len(head)])
    begin, end = np.zeros((2, len(data) + len(words)), np.int64)
    begin[head[fresh]], end[head[fresh]] = fresh, fresh + counts
    mass = np.zeros(len(data) + len(words))
    mass[first + np.arange(len(words))] = 1.0
    share = pieces.weight[piece]
    for d in range(1, int(min(lengths.max(initial=0), LONG_WORD)) + 1):
        a, b = np.searchsorted(depth, (d, d + 1))
        if a == b:
            continue
        x, y = np.searchsorted(fresh, (a, b))
        new, many = fresh[x:y], counts[x:y]
        share[a:b] *= mass[tail[a:b]]
        for k in range(1, int(many.max())):
            more = new[many > k] + k
            share[more] += share[more - 1]
        total = share[new + many - 1]
        mass[head[new]] = total
        share[a:b] /= np.repeat(total, many)
    return tail, piece, share, begin, end, first + np.arange(len(words)), lengths


def long_shares(pieces: Pieces, tail, piece, share, begin, end, first: int, length: int) -> None:
    """Forward filtering of one long word, in logarithms."""
    log = np.full(length + 1, -np.inf)
    log[0] = 0.0
    for k in range(1, length + 1):
        a, b = begin[first + k], end[first + k]
        if a == b:  # inside a character
            continue
        came = log[tail[a:b] - first] + pieces.log[piece[a:b]]
        top = came.max()
        running = np.cumsum(np.exp(came - top))
        share[a:b] = running / running[-1]
        log[k] = top + np.log(running[-1])


def sample_block(pieces: Pieces, words: list[bytes], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sampled pieces of the words, in order, and their number per word; ``keys`` seed the words."""
    known = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    tail, piece, share, begin, end, first, lengths = lattice(pieces, list(known))
    for w in np.flatnonzero(lengths > LONG_WORD):
        long_shares(pieces, tail, piece, share, begin, end, int(first[w]), int(lengths[w]))
    goal, at = first[ids], first[ids] + lengths[ids]
    active = np.flatnonzero(at > goal)
    drawn, number = [], np.zeros(len(words), np.int64)
    step = 0
    while len(active):
        node = at[active]
        u = uniform(keys[active], step)
        edge, last = begin[node], end[node] - 1
        more = np.flatnonzero((share[edge] <= u) & (edge < last))
        while len(more):
            edge[more] += 1
            more = more[(share[edge[more]] <= u[more]) & (edge[more] < last[more])]
        drawn.append((active, piece[edge]))
        number[active] += 1
        at[active] = tail[edge]
        active = active[at[active] > goal[active]]
        step += 1
    ends = np.cumsum(number)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
    for k, (who, what) in enumerate(drawn):
        out[ends[who] - 1 - k] = what
    return out, number


def row_key(seed: str, key: object) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}\0{key!r}".encode())


def sample_texts(pieces: Pieces, texts: list[str | None], keys: list, seed: str = SEED, block_bytes: int = BLOCK_BYTES) -> list[np.ndarray | None]:
    """Sampled ids of every text."""
    out: list[list[np.ndarray] | None] = [None if t is None else [] for t in texts]
    words: list[bytes] = []
    seeds: list[np.ndarray] = []
    owners: list[tuple[int, int]] = []
    held = 0

    def flush() -> None:
        nonlocal words, seeds, owners, held
        if words:
            ids, number = sample_block(pieces, words, np.concatenate(seeds))
            ends, at, done = np.r_[0, np.cumsum(number)], 0, 0
            for row, count in owners:
                done += count
                out[row].append(ids[at : ends[done]])
                at = ends[done]
        words, seeds, owners, held = [], [], [], 0

    for row, text in enumerate(texts):
        if not text:
            continue
        own = np.uint64(row_key(seed, keys[row]))
        parts = WORDS.findall(b" " + text.encode())
        at = 0
        while at < len(parts):
            some = parts[at : at + (block_bytes >> 3)]
            with np.errstate(over="ignore"):
                index = (own + np.arange(at, at + len(some)).astype(np.uint64) * WORD_STEP) * np.uint64(0xFF51AFD7ED558CCD)
            words += some
            seeds.append(index ^ (index >> np.uint64(32)))
            owners.append((row, len(some)))
            held += sum(map(len, some))
            at += len(some)
            if held >= block_bytes:
                flush()
    flush()
    return [None if o is None else np.concatenate(o) if o else np.empty(0, np.int32) for o in out]


def decode_ids(pieces: Pieces, ids) -> str:
    """The text of sampled ids, exactly."""
    whole = b"".join(map(pieces.spelled.__getitem__, ids))
    return whole[1:].decode()


def sample_pieces(
    docs: DataFrame, key: str = "doc_id", text: str = "text", model_path: str = MODEL_PATH, alpha: float = ALPHA,
    seed: str = SEED, verify: str | None = None,
) -> DataFrame:
    """``docs`` with ``piece_ids``; with ``verify``, a boolean column of that name: the ids decode to the text."""
    with open(model_path, "rb") as f:  # read once, by the driver; a vocabulary is of a fixed size
        pieces = Pieces(f.read(), alpha)
    rest = docs.drop("piece_ids", *([verify] if verify else []))
    schema = StructType([*rest.schema.fields, StructField("piece_ids", ArrayType(IntegerType()))])
    if verify:
        schema = schema.add(verify, BooleanType())
    key_at, text_at = rest.columns.index(key), rest.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_at):
                texts = part.column(text_at).to_pylist()
                ids = sample_texts(pieces, texts, part.column(key_at).to_pylist(), seed)
                columns = [*part.columns, id_lists(ids)]
                if verify:
                    columns.append(pa.array([t is None or decode_ids(pieces, i.tolist()) == t if t else i is None or not len(i)
                                             for t, i in zip(texts, ids, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rest.mapInArrow(run, schema)


def id_lists(ids: list[np.ndarray | None]) -> pa.Array:
    """Lists of ids as one Arrow array, nulls kept, without a Python object per id."""
    sizes = np.array([0 if i is None else len(i) for i in ids], np.int32)
    offsets = np.r_[np.int32(0), np.cumsum(sizes, dtype=np.int32)]
    flat = np.concatenate([i for i in ids if i is not None] or [np.empty(0, np.int32)]).astype(np.int32, copy=False)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=pa.array([i is None for i in ids], pa.bool_()))


def slices(batch: pa.RecordBatch, text_at: int, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``most`` bytes of text."""
    column = batch.column(text_at)
    if not batch.num_rows:
        return
    sizes = np.cumsum([0 if s is None else s for s in pa.compute.binary_length(column).to_pylist()])
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most, side="right")))
        yield batch.slice(at, end - at)
        at = end
