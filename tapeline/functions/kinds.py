"""Kinds of media files by their first bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the formats: kind, and bytes (in hex) at their offsets. The first that fits counts.
SIGNATURES = (
    ("wav", ((0, "52494646"), (8, "57415645"))),
    ("avi", ((0, "52494646"), (8, "41564920"))),
    ("flac", ((0, "664C6143"),)),
    ("ogg", ((0, "4F676753"),)),
    ("wma", ((0, "3026B2758E66CF11A6D900AA0062CE6C"),)),
    ("m4a", ((4, "66747970"), (8, "4D344120"))),
    ("m4v", ((4, "66747970"), (8, "4D345620"))),
    ("mov", ((4, "66747970"), (8, "71742020"))),
    ("mp4", ((4, "66747970"),)),
    ("mkv", ((0, "1A45DFA3"),)),
    ("mp3", ((0, "494433"),)),
    ("aac", ((0, "FFF1"),)),
    ("aac", ((0, "FFF9"),)),
    ("mp3", ((0, "FFFB"),)),
    ("mp3", ((0, "FFF3"),)),
    ("mp3", ((0, "FFF2"),)),
)
#: Bytes that decide; `webm` is a kind of mkv that names itself within them.
HEAD = 64
_WEBM = "4282847765626D"


def kind(head: Column) -> Column:
    """The kind of a file from its first HEAD bytes (fewer for shorter files); null if it is none of those known."""
    digits = F.hex(head)
    out = F.lit(None).cast("string")
    for name, marks in reversed(SIGNATURES):
        fits = F.lit(True)
        for at, mark in marks:
            fits = fits & (F.substring(digits, 2 * at + 1, len(mark)) == mark)
        found = F.when(F.contains(digits, F.lit(_WEBM)), "webm").otherwise(name) if name == "mkv" else F.lit(name)
        out = F.when(fits, found).otherwise(out)
    return out
