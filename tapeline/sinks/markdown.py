"""Markdown documents as files, and the sink that keeps nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeline.sinks.files import write_files


def write_markdown(docs: DataFrame, root: str) -> int:
    """Each document at its path below `root`, a folder of any store: parents made, existing files replaced."""
    return write_files(docs, root, "output_path", "content")


def discard(df: DataFrame) -> None:
    """Run everything, keep nothing."""
    df.write.format("noop").mode("overwrite").save()
