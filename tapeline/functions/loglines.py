"""Log lines: routing, classes, progress text, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeline.functions.text import LOG_SPACE

#: What marks progress lines, errors and successes; prefixes by level.
PROGRESS_MARKS = ("%|", "frames/s]", "it/s]")
ERROR_MARKS = ("error", "failed", "traceback")
SUCCESS_MARKS = ("saved:", "complete", "loaded")
PREFIXES = {"info": "INFO", "success": "OK", "error": "ERROR"}
PROGRESS = "Transcribing..."


def _any(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def cleaned(line: Column) -> Column:
    return F.btrim(line, F.lit(LOG_SPACE))


def is_progress(line: Column) -> Column:
    return _any(line, PROGRESS_MARKS)


def kind(line: Column) -> Column:
    """error before success before info."""
    low = F.lower(line)
    return F.when(_any(low, ERROR_MARKS), "error").when(_any(low, SUCCESS_MARKS), "success").otherwise("info")


def progress_text(line: Column) -> Column:
    """The first percentage, and with it the remaining time, if the line has them."""
    percent = F.regexp_extract(line, r"(?<!\d)\d{1,3}%", 0)
    left = F.regexp_extract(line, r"<([^,\]]+)", 1)
    known = F.concat(F.lit(PROGRESS + " "), percent)
    return F.when(percent == "", PROGRESS).when(left == "", known).otherwise(F.concat(known, F.lit(", ETA "), left))


def split_once(payload: Column) -> tuple[Column, Column]:
    """What is before and after the first bar."""
    parts = F.split(payload, r"\|", 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


def prefix(level: Column) -> Column:
    pairs = [F.lit(x) for pair in PREFIXES.items() for x in pair]
    return F.coalesce(F.create_map(*pairs)[level], F.lit(PREFIXES["info"]))


def formatted(ts: Column, level: Column, message: Column) -> Column:
    return F.concat(F.lit("["), F.date_format(ts, "HH:mm:ss"), F.lit("] "), prefix(level), F.lit(": "), message, F.lit("\n"))


def decoded(chunk: Column) -> Column:
    """Text of a binary chunk; null where it isn't UTF-8."""
    return F.try_validate_utf8(chunk.cast("string"))


def error_rows(case: Column, detail: Column, trace: Column) -> Column:
    """The rows of a failed run, an array of messages: what failed, by case, and the trace where there is one. The wording
    is this library's own."""
    message = (
        F.when(case == "helper", "The helper of the run is missing.")
        .when(case == "interpreter", F.concat(F.lit("No usable interpreter among: "), detail))
        .when(case == "exit", F.concat(F.lit("The run ended with code "), detail))
        .otherwise(F.concat(F.lit("Error: "), detail))
    )
    return F.array_compact(F.array(message, F.nullif(trace, F.lit(""))))
