"""Text that matches a regular expression, for the part of the syntax that specifications use."""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.synth.draws import choice, draw

OPEN_ENDED = 3  # how far beyond its least count an unbounded repetition may go
SPREAD = 2**26  # a draw is cut into characters only as far as they stay evenly spread
_DIGITS = string.digits
_WORD = string.ascii_letters + string.digits + "_"
_ESCAPES = {"d": _DIGITS, "w": _WORD, "s": " "}


class UnsupportedPattern(ValueError):
    """The expression uses syntax beyond classes, groups, alternatives and repetition."""


@dataclass(frozen=True)
class Chars:
    alphabet: str


@dataclass(frozen=True)
class Repeat:
    part: Chars | Choice
    low: int
    high: int


@dataclass(frozen=True)
class Choice:
    options: tuple[tuple[Repeat, ...], ...]


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self) -> str:
        ch = self.peek()
        self.at += 1
        return ch

    def options(self) -> Choice:
        found, current = [], []
        while self.peek() not in ("", ")"):
            ch = self.take()
            if ch == "|":
                found.append(tuple(current))
                current = []
            elif ch not in "^$":
                current.append(self.repeated(self.atom(ch)))
        return Choice((*found, tuple(current)))

    def atom(self, ch: str) -> Chars | Choice:
        if ch == "(":
            if self.text.startswith("?:", self.at):
                self.at += 2
            elif self.peek() == "?":
                raise UnsupportedPattern(self.text)
            inner = self.options()
            self.take()
            return inner
        if ch == "[":
            return Chars(self.char_class())
        if ch == "\\":
            ch = self.take()
            return Chars(_ESCAPES.get(ch, ch))
        return Chars(_WORD if ch == "." else ch)

    def char_class(self) -> str:
        if self.peek() == "^":
            raise UnsupportedPattern(self.text)
        out = ""
        while self.peek() != "]":
            ch = self.take()
            if ch == "\\":
                ch = self.take()
                out += _ESCAPES.get(ch, ch)
            elif self.peek() == "-" and self.text[self.at + 1] != "]":
                self.take()
                out += "".join(map(chr, range(ord(ch), ord(self.take()) + 1)))
            else:
                out += ch
        self.take()
        return out

    def repeated(self, part: Chars | Choice) -> Repeat:
        ch = self.peek()
        if ch in ("?", "*", "+"):
            self.take()
            low = 1 if ch == "+" else 0
            return Repeat(part, low, 1 if ch == "?" else low + OPEN_ENDED)
        if ch != "{":
            return Repeat(part, 1, 1)
        end = self.text.index("}", self.at)
        low, comma, high = self.text[self.at + 1 : end].partition(",")
        self.at = end + 1
        if not comma:
            return Repeat(part, int(low), int(low))
        return Repeat(part, int(low), int(high) if high else int(low) + OPEN_ENDED)


def matching_text(row: Column, salt: int, pattern: str) -> Column:
    """A text that matches the (anchored) pattern, drawn from the row number."""
    tree = _Reader(pattern).options()
    counter = iter(range(salt, salt + 100000))
    return _emit_choice(row, counter, tree)


def _emit_choice(row: Column, counter, tree: Choice) -> Column:
    options = tree.options
    if all(_plain(o) is not None for o in options) and len(options) > 1:
        return choice(row, next(counter), [_plain(o) for o in options])
    texts = [_emit_sequence(row, counter, o) for o in options]
    if len(texts) == 1:
        return texts[0]
    position = draw(row, next(counter)) % len(texts)
    out = F.when(position == 0, texts[0])
    for i, text in enumerate(texts[1:], 1):
        out = out.when(position == i, text)
    return out


def _plain(option: tuple[Repeat, ...]) -> str | None:
    """The literal text of an option that has no freedom."""
    out = ""
    for r in option:
        if r.low != r.high or not isinstance(r.part, Chars) or len(r.part.alphabet) != 1:
            return None
        out += r.part.alphabet * r.low
    return out


def _letters(row: Column, counter, alphabet: str, count: int) -> list[Column]:
    """``count`` characters of the alphabet; one draw is cut into as many as it can hold."""
    if len(alphabet) == 1:
        return [F.lit(alphabet)] * count
    size = len(alphabet)
    per_draw = 1
    while size ** (per_draw + 1) < SPREAD:
        per_draw += 1
    out: list[Column] = []
    while len(out) < count:
        drawn = draw(row, next(counter))
        for i in range(min(per_draw, count - len(out))):
            rest = F.floor(drawn / F.lit(size**i)) if i else drawn
            out.append(F.substr(F.lit(alphabet), (rest % size + 1).cast("int"), F.lit(1)))
    return out


def _emit_sequence(row: Column, counter, option: tuple[Repeat, ...]) -> Column:
    pieces = [F.lit("")]
    for r in option:
        if isinstance(r.part, Chars):
            texts = _letters(row, counter, r.part.alphabet, r.high)
        else:
            texts = [_emit_choice(row, counter, r.part) for _ in range(r.high)]
        size = draw(row, next(counter)) % (r.high - r.low + 1) + r.low if r.high > r.low else None
        for i, text in enumerate(texts):
            pieces.append(text if i < r.low else F.when(size > i, text).otherwise(F.lit("")))
    return F.concat(*pieces)
