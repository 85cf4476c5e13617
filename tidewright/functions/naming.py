"""Column and table names as identifiers."""

from __future__ import annotations

import re


def identifier(name: str) -> str:
    """Lower snake case: words split at case changes, other characters to underscores."""
    spaced = re.sub(r"[^0-9A-Za-z]+", "_", name)
    # a capital that opens a new word: after a small letter, or before one at the end of capitals
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", spaced)
    out = re.sub(r"_+", "_", spaced).strip("_").lower()
    if not out:
        return "unknown"
    return f"col_{out}" if out[0].isdigit() else out


def sanitised(df):
    """The frame with identifier-safe column names."""
    return df.toDF(*[identifier(c) for c in df.columns])
