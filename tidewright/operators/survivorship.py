"""One value per key out of several sources."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNRANKED = 999


@dataclass(frozen=True)
class Candidate:
    """A column that may supply the value, with its priority (low wins) and its timestamp."""

    value: Column
    source: str
    priority: int | None = None
    stamp: Column | None = None


def _ranked(candidates: Sequence[Candidate]) -> list[Candidate]:
    return sorted(candidates, key=lambda c: UNRANKED if c.priority is None else c.priority)


def _filled(value: Column, text: bool) -> Column:
    return F.nullif(value, F.lit("")) if text else value


def _with_default(value: Column, default: Any, dtype: T.DataType | str | None) -> Column:
    if default is None:
        return value
    literal = F.lit(default)
    return F.coalesce(value, literal.cast(dtype) if dtype is not None else literal)


def default_only(dtype: T.DataType | str, default: Any = None) -> Column:
    """No candidate at all: the typed default, or a typed NULL."""
    return F.lit(default).cast(dtype)


def by_priority(
    candidates: Sequence[Candidate],
    default: Any = None,
    dtype: T.DataType | str | None = None,
    text: bool = False,
) -> Column:
    """First candidate with a value, lowest priority number first; text treats '' as missing."""
    values = [_filled(c.value, text and len(candidates) > 1) for c in _ranked(candidates)]
    value = F.coalesce(*values) if values else F.lit(None)
    return _with_default(value, default, dtype)


def greatest(
    candidates: Sequence[Candidate], default: Any = None, dtype: T.DataType | str | None = None
) -> Column:
    values = [c.value for c in _ranked(candidates)]
    value = F.greatest(*values) if len(values) > 1 else values[0]
    return _with_default(value, default, dtype)


def _pick(candidates: Sequence[Candidate], measure, text: bool) -> Column:
    """Value of the candidate with the largest measure; priority order breaks ties."""
    entries = [
        F.when(
            _filled(c.value, text).isNotNull(),
            F.struct(measure(c).alias("m"), F.lit(-i).alias("p"), c.value.alias("v")),
        )
        for i, c in enumerate(_ranked(candidates))
    ]
    return F.array_max(F.array(*entries))["v"]


def most_recent(
    candidates: Sequence[Candidate],
    default: Any = None,
    dtype: T.DataType | str | None = None,
    text: bool = False,
) -> Column:
    """The value with the newest timestamp; a missing timestamp is the oldest."""
    return _with_default(_pick(candidates, lambda c: c.stamp, text), default, dtype)


def longest(candidates: Sequence[Candidate], default: Any = None) -> Column:
    return _with_default(_pick(candidates, lambda c: F.length(c.value), True), default, None)


def attribution(candidates: Sequence[Candidate], text: bool = False) -> Column:
    """Name of the source that ``by_priority`` takes the value from, NULL if none has one."""
    return F.coalesce(
        *[
            F.when(_filled(c.value, text and len(candidates) > 1).isNotNull(), F.lit(c.source))
            for c in _ranked(candidates)
        ]
    )
