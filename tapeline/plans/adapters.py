"""The fixture tables as files, segments, settings and log lines. Adapters are this repository's own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Log lines that stand for event types; `{v}` is the whole part of the event's value, `{u}` the user.
TEMPLATES = {
    "view": " {v}%| 10/20 [00:03<00:0{d}, 9frames/s]",
    "click": "Loading model '{v}'",
    "error": "Error: file {v} failed",
    "purchase": "Saved: /out/{u}/{v}.md",
    "signup": "{v}it/s]",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as segments: a turn lasts 60 ms a character, one after the other."""
    ms = F.length("text") * 60
    upto = F.sum(ms).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = table(spark, sf_dir, "conversations").withColumn("upto", upto)
    return rows.select(
        F.col("conv_id").alias("file_index"), F.col("turn").alias("segment_index"), ((F.col("upto") - ms) / 1000).alias("start"), (F.col("upto") / 1000).alias("end"), "text"
    )


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log lines: event_id, ts, user_id, line."""
    v = F.floor("value").cast("string")
    line = F.lit(None).cast("string")
    for kind, template in TEMPLATES.items():
        text = F.lit(template)
        for mark, value in (("{v}", v), ("{u}", F.col("user_id").cast("string")), ("{d}", (F.col("event_id") % 10).cast("string"))):
            text = F.replace(text, F.lit(mark), value)
        line = F.when(F.col("event_type") == kind, text).otherwise(line)
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", line.alias("line"))


def line_sql() -> str:
    """The same in DuckDB."""
    cases = " ".join(
        f"WHEN event_type = '{k}' THEN replace(replace(replace('{t.replace(chr(39), chr(39) * 2)}', '{{v}}', CAST(CAST(floor(value) AS BIGINT) AS VARCHAR)), '{{u}}', CAST(user_id AS VARCHAR)), '{{d}}', CAST(event_id % 10 AS VARCHAR))"
        for k, t in TEMPLATES.items()
    )
    return f"SELECT event_id, ts, user_id, CASE {cases} END AS line FROM events"
