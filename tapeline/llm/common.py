"""Column helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word, as all operators here count it: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Where a row stands: a file (its hash) and its row there.
PLACE = "struct<file: bigint, row: bigint>"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Texts that are all ASCII take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def unit(*cols: Column) -> Column:
    """A reproducible number in [0, 1) from the values of `cols`."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 53)) / F.lit(float(1 << 53))


def fresh(df: DataFrame, stem: str) -> str:
    """`stem`, or a variant of it that no column of `df` has."""
    have = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in have:
        name += "_"
    return name


def every(df: DataFrame) -> list[Column]:
    """All columns of `df`, whatever their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def without(docs: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """The rows of `docs` whose `key` isn't in the one column of `gone`; rows with a null key stay. No column of `docs` can
    clash with what the join needs. Merged at every size, so that the plan at scale is the plan everywhere."""
    name = fresh(docs, "gone_key")
    own = fresh(docs, "own_key")
    held = gone.toDF(name).hint("merge")
    columns = every(docs)
    return docs.withColumn(own, key).join(held, F.col(own) == F.col(name), "left_anti").select(*columns)
