"""Strings: trimming, defaults, quoting, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that strip() removes, by code point; line breaks; white space of log lines.
STRIPPED = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LINE_BREAKS = "\n\x0b\x0c\r\x85\u2028\u2029"
LOG_SPACE = "".join(c for c in STRIPPED if not "\x1c" <= c <= "\x1f")


def strip(text: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(text, F.lit(STRIPPED))


def default_text(text: Column, other: str) -> Column:
    """Stripped text, or `other` where nothing is left."""
    return F.coalesce(F.nullif(strip(text), F.lit("")), F.lit(other))


def yaml_quote(text: Column) -> Column:
    """Double-quoted YAML: backslashes first, then quotes. Null gives null."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def clamp(number: Column, low: int, high: int | None = None) -> Column:
    out = F.greatest(F.lit(low), number)
    return out if high is None else F.least(F.lit(high), out)


def count_label(n: Column, one: str = "file", many: str = "files", tail: str = " selected") -> Column:
    """`No files selected`, `1 file selected`, `n files selected`."""
    return F.when(n == 0, f"No {many}{tail}").when(n == 1, f"1 {one}{tail}").otherwise(F.concat(n.cast("string"), F.lit(f" {many}{tail}")))


def lines(text: Column) -> Column:
    """An array of the text's lines, cut at every line break character."""
    return F.split(text, f"[{LINE_BREAKS}]", -1)
