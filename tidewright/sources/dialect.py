"""How delimited text is written."""

from __future__ import annotations

from dataclasses import dataclass

# Charset names as people write them and as Java knows them.
CHARSETS = {
    "ascii": "US-ASCII",
    "us-ascii": "US-ASCII",
    "latin1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "latin_1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1",
    "iso8859-1": "ISO-8859-1",
    "iso_8859_1": "ISO-8859-1",
    "cp1252": "windows-1252",
    "windows1252": "windows-1252",
    "windows-1252": "windows-1252",
    "utf8": "UTF-8",
    "utf-8": "UTF-8",
    "utf_8": "UTF-8",
    "utf16": "UTF-16",
    "utf-16": "UTF-16",
    "utf_16": "UTF-16",
}
NULL_MARK = r"\N"


def charset(name: str) -> str:
    return CHARSETS.get(name.strip().casefold(), name)


@dataclass(frozen=True)
class Delimited:
    """How a text source is written."""

    delimiter: str = "|"
    header: bool = True
    encoding: str = "UTF-8"
    null_value: str | None = None
    null_escape: str | None = None
    comment: str | None = None
    quote: str | None = None
    escape: str | None = None
    skip_rows: int = 0
    footer_rows: int = 0
    line_terminator: str | None = None
    multiline: bool = False

    @property
    def is_dump(self) -> bool:
        """Preamble, footer, own line ends or null marks need the line-wise reader."""
        return bool(
            self.skip_rows or self.footer_rows or self.line_terminator or self.null_escape
        )

    def options(self) -> dict[str, str]:
        out = {
            "sep": self.delimiter,
            "header": str(self.header).lower(),
            "encoding": charset(self.encoding),
            "inferSchema": "false",
        }
        if self.multiline:
            out["multiLine"] = "true"
        for name, value in (
            ("nullValue", self.null_value),
            ("comment", self.comment),
            ("quote", self.quote),
            ("escape", self.escape),
        ):
            if value is not None:
                out[name] = value
        return out
