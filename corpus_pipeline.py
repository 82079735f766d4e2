"""A corpus pipeline of five stages; each one's rows are written as Parquet and read again as the next one's documents.

Rows are judged one by one, by their place in the files, whatever their ids. Null, empty and wordless texts have no language
and go in the first stage, ambiguous ones too; rows that are equal or nearly so leave one row, the first or last by doc_id as
the operators say; a null doc_id is the smallest to the second stage and linked with nothing in the third; a null source is a source. Columns
beside those of `documents` are carried along by all stages but the last, whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm import exact_dedup, langid, mixing, near_dedup, packing
from tapeline.session import ship, work_path


#: Near duplicates of the corpus: shingles of five words, a similarity of 0.8 or more. (The query of the operator alone has
#: a contract of its own, three words and 0.85.)
WIDTH, PERCENT = 5, 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return langid.drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.drop_near_duplicates(docs, width=WIDTH, percent=PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("packing", pack)]

#: Language models, hashing draws and packing can't be put in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
