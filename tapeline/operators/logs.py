"""Log lines: one transformation for batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.functions import loglines
from tapeline.functions.text import lines


def split_lines(df: DataFrame, column: str) -> DataFrame:
    """One row per non-blank line, trimmed: the other columns, `line_no` in the text (from 0), `line`."""
    rest = [c for c in df.columns if c != column]
    cut = df.select(*rest, F.posexplode(lines(F.col(column))).alias("line_no", "line"))
    return cut.withColumn("line", loglines.cleaned(F.col("line"))).where(F.col("line") != "")


def routed(df: DataFrame, column: str = "line") -> DataFrame:
    """`route` (progress or log), `kind` of log lines, and the `message` to show."""
    line = F.col(column)
    progress = loglines.is_progress(line)
    return (
        df.withColumn("route", F.when(progress, "progress").otherwise("log"))
        .withColumn("kind", F.when(~progress, loglines.kind(line)))
        .withColumn("message", F.when(progress, loglines.progress_text(line)).otherwise(line))
    )


def log_rows(df: DataFrame) -> DataFrame:
    return df.where("route = 'log' and message is not null and message <> ''")


def latest(df: DataFrame, key: str, seq: str, value: str = "message") -> DataFrame:
    """The last value of each key: the progress cell."""
    return df.groupBy(key).agg(F.max_by(value, seq).alias(value), F.max(seq).alias(seq))


def decoded(df: DataFrame, payload: str = "payload") -> DataFrame:
    """`level` and `message` of `level|message`; null payloads go."""
    level, message = loglines.split_once(F.col(payload))
    return df.where(F.col(payload).isNotNull()).withColumn("level", level).withColumn("message", message)
