"""A running index over a whole table, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.session import materialise


def with_index(df: DataFrame, *order: str | Column, name: str = "file_index", first: int = 1) -> DataFrame:
    """`df` with an index from `first` on, in the order of `order`: one shuffle into sorted ranges, whose rows are numbered
    where they lie and moved on by the sizes of the ranges before. Ties get different numbers."""
    at = "_at"
    dealt = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "indexed")
    # The number holds the range (high bits) and the place in it (low bits), as Spark documents it.
    part, place = F.shiftrightunsigned(at, 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = dealt.groupBy(part.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    # One row per range, whatever the table: small enough to broadcast.
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = dealt.withColumn("_range", part).join(F.broadcast(before), "_range")
    return rows.withColumn(name, place + F.col("_before") + first).drop("_range", "_before", at)
