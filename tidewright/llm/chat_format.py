r"""Chat formatting with a grammar round trip.

A conversation is rendered as ``<|im_start|>role\ntext<|im_end|>\n`` per turn. A deterministic parser reads the
rendered text back; turns that do not come back identical are escaped and rendered again, until the whole
conversation does. An escape puts one backslash between ``<`` (and any backslashes that follow it) and ``|``;
the parser takes one away, so every text survives, with control strings or escapes of its own included. A line
break in a role becomes the control string ``<|nl|>``.

Defined results: null texts and roles are empty; turns stand in the order of (turn, role, text), nulls first, so
ties are ordered and repeated rows are turns of their own; a null conversation id is a conversation; an empty
table gives an empty table; other columns are left out.

Rows are dealt by conversation, sorted, and streamed, so a task holds one conversation's rendered text at a time
(which is the result itself) and never a group of conversations.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"
OPENING = re.compile(r"<(\\*)\|")
ESCAPED = re.compile(r"<\\(\\*)\|")

Turn = tuple[str, str]


def escape(text: str) -> str:
    return OPENING.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text)


def render_turn(role: str, text: str, escaped: bool) -> str:
    if escaped:
        role, text = escape(role).replace("\n", BREAK), escape(text)
    return f"{START}{role}\n{text}{END}\n"


def parse(rendered: str) -> list[Turn] | None:
    """The turns of a rendered conversation; None where the grammar does not hold."""
    turns, at = [], 0
    while at < len(rendered):
        line, stop = rendered.find("\n", at), rendered.find(END, at)
        if not rendered.startswith(START, at) or line < 0 or stop < line or not rendered.startswith("\n", stop + len(END)):
            return None
        role, text = rendered[at + len(START) : line], rendered[line + 1 : stop]
        if START in role or START in text:
            return None
        turns.append((unescape(role.replace(BREAK, "\n")), unescape(text)))
        at = stop + len(END) + 1
    return turns


def render(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """Rendered text and the spans of the loss mask (the escaped texts of the assistant), in code points."""
    escaped = [parse(render_turn(r, t, False)) != [(r, t)] for r, t in turns]
    while True:
        parts = [render_turn(r, t, e) for (r, t), e in zip(turns, escaped, strict=True)]
        whole = "".join(parts)
        back = parse(whole)
        if back == turns:
            break
        if all(escaped):
            raise ValueError("a conversation does not come back from its rendered text")
        same_length = back is not None and len(back) == len(turns)
        escaped = [e or not same_length or back[i] != turns[i] for i, e in enumerate(escaped)]
    spans, at = [], 0
    for (role, _), part in zip(turns, parts, strict=True):
        if role == LOSS_ROLE:
            spans.append((at + part.index("\n") + 1, at + len(part) - len(END) - 1))
        at += len(part)
    return whole, spans


def _conversations(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, list[Turn]]]:
    """Turns per conversation of a stream that is sorted by conversation."""
    key, turns, begun = None, [], False
    for batch in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
            if begun and conv != key:
                yield key, turns
                turns = []
            key, begun = conv, True
            turns.append((role or "", text or ""))
    if begun:
        yield key, turns


def format_conversations(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per conversation: conv_id, ``formatted`` and ``loss_spans`` (start, end in code points)."""
    kind = rows.schema[conv_id].dataType.simpleString()
    # the Arrow types of the result: Spark's 64-bit ids and UTF-8 texts
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, spans, held, key_type = [], [], [], 0, None

        def typed(stream):
            nonlocal key_type
            for b in stream:
                key_type = b.schema.field(0).type
                yield b

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(texts, pa.string()), pa.array(spans, span)], names=["conv_id", "formatted", "loss_spans"]
            )

        for key, turns in _conversations(typed(batches)):
            whole, mask = render(turns)
            keys.append(key)
            texts.append(whole)
            spans.append([{"start": a, "end": b} for a, b in mask])
            held += len(whole)
            if held > 1 << 22:
                yield out()
                keys, texts, spans, held = [], [], [], 0
        if keys:
            yield out()

    chosen = rows.select(F.col(conv_id).alias("c"), F.col(role).cast("string").alias("r"), F.col(text).cast("string").alias("x"), F.col(turn).alias("t"))
    dealt = chosen.repartition("c").sortWithinPartitions("c", "t", "r", "x")
    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<start: long, end: long>>")


def digests(formatted: str, spans: list[dict]) -> tuple[int, str, int, str, int]:
    """n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars: all read back from the rendered text."""
    turns = parse(formatted)
    if turns is None:
        raise ValueError("the rendered text does not parse")
    of_turns, of_loss, chars = hashlib.sha256(), hashlib.sha256(), 0
    for role, text in turns:
        of_turns.update(f"{role}\n{text}\n".encode())
    for span in spans:
        text = unescape(formatted[span["start"] : span["end"]])
        of_loss.update(text.encode())
        chars += len(text)
    return len(turns), of_turns.hexdigest(), chars, of_loss.hexdigest(), len(formatted)


DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id and the digests of every formatted conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digests(f, s) for f, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            parts = list(zip(*found, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(p, k) for p, k in zip(parts, kinds, strict=True)]],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    kind = formatted.schema["conv_id"].dataType.simpleString()
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, f"conv_id {kind}, {DIGESTS}")
