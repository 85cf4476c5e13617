"""Date and time formats: the registry, its Java patterns, and field-width shapes."""

from __future__ import annotations

import re
from functools import lru_cache

# The accepted date, date-time and time-only formats, in order of preference.
DATE_FORMATS = (
    "YYYY-MM-DD",
    "YYYY/MM/DD",
    "MM/DD/YYYY",
    "MM-DD-YYYY",
    "M/D/YYYY",
    "M/d/YYYY",
    "M/d/yyyy",
    "YYYYMMDD",
    "MMDDYYYY",
)
DATETIME_FORMATS = (
    "YYYY-MM-DD HH:MM:SS",
    "YYYY-MM-DDTHH:MM:SS",
    "YYYY-MM-DD HH:MM",
    "MM/DD/YYYY HH:MM:SS",
    "MM/DD/YYYY hh:mm:ss A",
    "M/D/YYYY h:mm A",
    "M/d/YYYY h:mm A",
    "M/d/yyyy h:mm a",
    "M/d/yyyy, h:mm a",
    "MM/dd/yyyy h:mma",
    "MM/dd/yyyy h:mmA",
    "MM/DD/YYYY hh:mm A",
    "M/D/YYYY, h:mm A",
    "M/D/YYYY h:mm:ss A",
    "YYYY-MM-DD HH:mm:ss",
    "YYYY-MM-DD HH:MM:SS.SSSSSS",
    "YYYY-MM-DD HH:MM:SS.SSS",
)
TIME_FORMATS = ("HH:MM:SS", "HH:MM", "hh:mm:ss A", "hh:mm A", "h:mm a")

REGISTRY = frozenset(DATE_FORMATS + DATETIME_FORMATS + TIME_FORMATS)

_RUN = re.compile(r"([A-Za-z])\1*|[^A-Za-z]+")


@lru_cache(maxsize=None)
def java_pattern(fmt: str) -> str:
    """Spark's pattern for a specification format.

    Letters are read run by run. Hours switch to the time part, where MM means minutes; an S run
    straight after a dot is a fraction of a second.
    """
    out, in_time, last = [], False, ""
    for run in (m.group(0) for m in _RUN.finditer(fmt)):
        letter = run[0]
        if letter in "Yy":
            out.append("y" * len(run))
        elif letter in "Dd":
            out.append("d" * len(run))
        elif letter in "Hh":
            in_time = True
            out.append(run)
        elif letter in "Mm":
            out.append(("m" if in_time or letter == "m" else "M") * len(run))
        elif letter in "Ss":
            out.append(("S" if last.endswith(".") else "s") * len(run))
        elif letter in "Aa":
            out.append("a")
        elif letter == "T":
            out.append("'T'")
        else:
            out.append(run)
        last = run
    return "".join(out)


@lru_cache(maxsize=None)
def width_regex(fmt: str) -> str:
    """Anchored regular expression of the text widths the Java pattern can read.

    A text that fails it cannot parse, so it is a cheap guard in front of the parser, whose
    failures cost an exception per row.
    """
    return pattern_widths(java_pattern(fmt))


def has_names(pattern: str) -> bool:
    """Whether a Java pattern reads names of months or days, whose widths vary."""
    return re.search("E|MMM|LLL|z|Z|V|x|X", re.sub("'[^']*'", "", pattern)) is not None


def pattern_widths(pattern: str) -> str:
    """The widths of a Java pattern without names, as an anchored regular expression."""
    out, i, last = [], 0, ""
    while i < len(pattern):
        c = pattern[i]
        if c == "'":
            end = pattern.index("'", i + 1)
            out.append(re.escape(pattern[i + 1 : end]))
            i, last = end + 1, "'"
            continue
        if c.isalpha():
            n = len(pattern) - len(pattern[i:].lstrip(c)) - i
            if c == "a":
                out.append("[AaPp][Mm]")
            elif c == "S":
                out.append(rf"\d{{1,{n}}}")
            elif n == 1:
                out.append(r"\d+")
            else:
                out.append(rf"\d{{{n}}}")
            i += n
        else:
            out.append(re.escape(c) if c != " " else " ")
            i += 1
        last = c
    return "^" + "".join(out) + "$"


def parse_order(first: str | None = None, *, dates: bool = True, datetimes: bool = True) -> list[str]:
    """Formats to try in turn: the declared one, then the registry, one per distinct pattern."""
    ordered: dict[str, str] = {}
    wanted = ((first,) if first else ()) + (DATE_FORMATS if dates else ()) + (
        DATETIME_FORMATS if datetimes else ()
    )
    for fmt in wanted:
        ordered.setdefault(java_pattern(fmt), fmt)
    return list(ordered.values())


# Strftime directives and their Java letters.
STRFTIME_TO_JAVA = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%-m": "M",
    "%d": "dd",
    "%-d": "d",
    "%H": "HH",
    "%-H": "H",
    "%I": "hh",
    "%-I": "h",
    "%M": "mm",
    "%S": "ss",
    "%f": "SSSSSS",
    "%p": "a",
    "%b": "MMM",
    "%B": "MMMM",
    "%j": "DDD",
    "%%": "%",
}


@lru_cache(maxsize=None)
def strftime_pattern(fmt: str) -> str:
    """Spark's pattern for a strftime format; other letters are quoted as literals."""
    out = []
    for part in re.findall(r"%-?.|[A-Za-z]+|[^%A-Za-z]+", fmt):
        if part.startswith("%"):
            if part not in STRFTIME_TO_JAVA:
                raise ValueError(f"unsupported strftime directive {part!r}")
            out.append(STRFTIME_TO_JAVA[part])
        elif part[0].isalpha():
            out.append(f"'{part}'")
        else:
            out.append(part)
    return "".join(out)


# Java letters and their strftime directives.
JAVA_TO_STRFTIME = {
    "yyyy": "%Y",
    "yy": "%y",
    "MM": "%m",
    "M": "%-m",
    "dd": "%d",
    "d": "%-d",
    "HH": "%H",
    "H": "%-H",
    "hh": "%I",
    "h": "%-I",
    "mm": "%M",
    "ss": "%S",
    "a": "%p",
}


@lru_cache(maxsize=None)
def strftime_of(fmt: str) -> str:
    """The strftime format of a specification format."""
    out = []
    for run in (m.group(0) for m in _RUN.finditer(java_pattern(fmt).replace("'T'", "\0"))):
        if run[0] == "S":
            out.append("%f")
        elif run[0].isalpha():
            out.append(JAVA_TO_STRFTIME[run])
        else:
            out.append(run.replace("\0", "T"))
    return "".join(out)
