"""Transcription results that arrive as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.schemas import RESULT


def parse_results(df: DataFrame, column: str = "json") -> DataFrame:
    """`result` from a JSON column; missing segments are none, missing or null text is empty."""
    raw = F.from_json(F.col(column), RESULT)
    segments = F.coalesce(raw["segments"], F.array().cast("array<struct<start:double,end:double,text:string>>"))
    return df.withColumn("result", F.struct(F.coalesce(raw["text"], F.lit("")).alias("text"), segments.alias("segments"))).drop(column)
