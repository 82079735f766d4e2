"""Segments to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.functions import paths
from tapeline.functions.text import strip, yaml_quote
from tapeline.functions.timecode import FPS, timecode
from tapeline.schemas import Settings


def explode_results(results: DataFrame, result: str = "result") -> DataFrame:
    """One row per segment, with its position; missing times are 0, missing text is empty."""
    rest = [c for c in results.columns if c != result]
    rows = results.select(*rest, F.posexplode_outer(F.col(f"{result}.segments")).alias("segment_index", "_s"))
    return rows.where("segment_index is not null").select(
        *rest, "segment_index", F.coalesce("_s.start", F.lit(0.0)).alias("start"), F.coalesce("_s.end", F.lit(0.0)).alias("end"), F.coalesce("_s.text", F.lit("")).alias("text")
    )


def prepare(segments: DataFrame) -> DataFrame:
    """Segments with text left after stripping, their timecodes, and their block."""
    text, start, end = strip(F.coalesce("text", F.lit(""))), timecode(F.col("start")), timecode(F.col("end"))
    rows = segments.withColumn("text", text).where(F.col("text") != "").withColumn("start_tc", start).withColumn("end_tc", end)
    return rows.withColumn("block", F.concat("start_tc", F.lit(" - "), "end_tc", F.lit("\n"), "text"))


def joined(order: str, value: str, separator: str) -> Column:
    """An ordered string aggregate; null over no rows."""
    return F.expr(f"listagg({value}, '{separator}') within group (order by {order})")


def bodies(prepared: DataFrame, key: str, order: str = "segment_index") -> DataFrame:
    """One row per file: number of blocks and the timed body."""
    return prepared.groupBy(key).agg(F.count("block").alias("n_blocks"), joined(order, "block", r"\n\n").alias("timed"))


def chosen_body(timed: Column, full_text: Column, wanted: bool = True) -> Column:
    """Timed blocks if wanted and there are any, else the full text, stripped."""
    plain = strip(F.coalesce(full_text, F.lit("")))
    return F.coalesce(strip(timed), plain) if wanted else plain


def document(path: Column, created: Column, body: Column, settings: Settings) -> Column:
    """The Markdown text. Keys and layout are fixed values of the format."""
    keys = [
        ("created", yaml_quote(F.date_format(created, "yyyy-MM-dd HH:mm"))), ("model", yaml_quote(F.lit(settings.model_name))), ("device", yaml_quote(F.lit(settings.device))),
        ("source_file", yaml_quote(paths.name(path))), ("fps_timecode", F.lit(str(FPS))),
    ]
    if settings.timecodes_key:
        keys.append(("timecodes", F.lit(settings.include_timecodes).cast("string")))
    front = [x for k, v in keys for x in (F.lit(f"{k}: "), v, F.lit("\n"))]
    return F.concat(F.lit("---\n"), *front, F.lit(f"---\n\n# {settings.heading}: "), paths.stem(path), F.lit("\n\n---\n\n"), body, F.lit("\n"))


def render(files: DataFrame, settings: Settings, created: Column) -> DataFrame:
    """`files` (file_index, path, timed, full_text) as documents, one for each output path: the last file's."""
    out = paths.target(F.col("path"), F.lit(settings.output_folder).cast("string"))
    body = chosen_body(F.col("timed"), F.col("full_text"), settings.include_timecodes)
    docs = files.select("file_index", out.alias("output_path"), document(F.col("path"), created, body, settings).alias("content"))
    return keep_last(docs, "output_path", "file_index")


def keep_last(df: DataFrame, key: str, index: str) -> DataFrame:
    """The row of greatest `index` for each `key`, and how many it overwrote (`overwritten`)."""
    rest = [c for c in df.columns if c != key]
    got = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(index)).alias("_row"), (F.count(F.lit(1)) - 1).alias("overwritten"))
    return got.select(key, "_row.*", "overwritten")


def arguments(settings: Settings, files: Column) -> Column:
    """The argument vector of a run: an array of strings from an array of paths."""
    fixed = ["--language", settings.language, "--model", settings.model_name, "--buffer", str(settings.buffer_seconds)]
    fixed += ["--timecodes"] if settings.include_timecodes else []
    fixed += ["--output-dir", settings.output_folder] if settings.output_folder else []
    return F.concat(F.array(*map(F.lit, fixed)), F.flatten(F.transform(files, lambda x: F.array(F.lit("--file"), x))))
