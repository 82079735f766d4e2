"""Choosing files: first of each key, not chosen before, appended in order, counted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.functions.text import count_label
from tapeline.operators.ordering import with_index


def first_of_each(df: DataFrame, key: str, index: str) -> DataFrame:
    """The row of least `index` for each `key`: a partial aggregate, so hot keys cost a row per task. Keys may be long texts:
    they meet by SHA-256 and travel once."""
    return _first(df.withColumn("_digest", F.sha2(F.col(key), 256)), index).select(*df.columns)


def _first(df: DataFrame, index: str) -> DataFrame:
    rest = [c for c in df.columns if c != "_digest"]
    return df.groupBy("_digest").agg(F.min_by(F.struct(*rest), F.col(index)).alias("_row")).select("_digest", "_row.*")


def additions(existing: DataFrame, chosen: DataFrame, key: str, index: str, within_batch: bool = True) -> DataFrame:
    """Rows of `chosen` whose key isn't in `existing`; within a batch the first of a key, unless switched off. Keys meet by their
    SHA-256, on which the first of each are found too, so one shuffle serves both."""
    digest = F.sha2(F.col(key), 256)
    new = chosen.withColumn("_digest", digest)
    new = _first(new, index) if within_batch else new
    return new.join(existing.select(digest.alias("_digest")).distinct(), "_digest", "left_anti").select(*chosen.columns)


def append(existing: DataFrame, chosen: DataFrame, key: str, index: str) -> DataFrame:
    """Existing rows, then additions, with a new running `file_index`."""
    both = existing.withColumn("_part", F.lit(0)).unionByName(additions(existing, chosen, key, index).withColumn("_part", F.lit(1)))
    return with_index(both, "_part", index).drop("_part")


def identified(df: DataFrame, name: str = "id") -> DataFrame:
    """`df` with a random UUID for each row; write it before it is used twice."""
    return df.withColumn(name, F.uuid() if hasattr(F, "uuid") else F.expr("uuid()"))


def cleared(existing: DataFrame) -> DataFrame:
    return existing.limit(0)


def count_text(df: DataFrame, *by: str) -> DataFrame:
    """Number of rows and its label for each group; over no group, also for an empty table."""
    n = F.count(F.lit(1))
    return (df.groupBy(*by) if by else df).agg(n.alias("n"), count_label(n).alias("label"))


def progress(df: DataFrame, batch: Sequence[str], index: str) -> DataFrame:
    """Position `i/n` in the row's batch, and whether another follows (a pause would). Over all rows if `batch` is empty."""
    if not batch:
        rows, n = with_index(df, index), F.lit(df.count())
        return rows.withColumn("label", F.concat(F.col("file_index").cast("string"), F.lit("/"), n.cast("string"))).withColumn("waits", F.col("file_index") < n).drop("file_index")
    by = Window.partitionBy(*batch)
    i, n = F.row_number().over(by.orderBy(index)), F.count(F.lit(1)).over(by)
    return df.withColumn("label", F.concat(i.cast("string"), F.lit("/"), n.cast("string"))).withColumn("waits", i < n)


def first_candidate(df: DataFrame, group: str, priority: str, value: str, ok: Column) -> DataFrame:
    """The value of best priority that is ok, and those rejected before it, in order, a line each."""
    checked = df.withColumn("_ok", ok)
    best = checked.groupBy(group).agg(F.min(F.when(F.col("_ok"), F.col(priority))).alias("_at"), F.min_by(F.when(F.col("_ok"), F.col(value)), F.when(F.col("_ok"), F.col(priority))).alias("chosen"))
    failed = checked.where(~F.col("_ok")).join(best.select(group, "_at"), group).where(F.col("_at").isNull() | (F.col(priority) < F.col("_at")))
    rejected = failed.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(priority, value))), lambda x: x[value]), "\n").alias("rejected"))
    return best.join(rejected, group, "left").select(group, "chosen", F.coalesce("rejected", F.lit("")).alias("rejected"))
