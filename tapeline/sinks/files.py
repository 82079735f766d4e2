"""One text file a row, named by the row, on any store that Spark can write to."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import suppress
from functools import partial
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tapeline.functions import paths
from tapeline.stores import Store

AT_ONCE, WINDOW = 16, 1024


class OutsideRoot(ValueError):
    """A row's path leaves the folder of the files."""


def write_files(docs: DataFrame, root: str, path: str = "output_path", content: str = "content") -> int:
    """Each row's text at its path below `root`, in UTF-8, parents made, files that are there replaced; the number of files.

    Two steps, as Spark's own writers take: tasks write the texts into a staging folder below `root` (named by their paths' digests),
    then, when all have, each file is renamed to its place: on disks (`file:`, mounted everywhere as for Spark's own writers) by
    tasks, on other stores by the driver, some at a time, a window of names in memory, since tasks have no handle on them. A
    reader finds a file's old text or its new one. If the job fails before the second step nothing has changed, and the
    staging folder goes in any case, with what lost attempts left there. Should the driver be lost while renaming, some files are
    new and others old; running again makes all new.

    A path is taken as below `root` whatever it begins with; `..` steps that leave it fail the job before anything is moved. Of rows
    with one path, the one with the greatest text stays: say which one is to stay before (`keep_last`). Rows without a path have
    no file; a null text is empty. The last line gets its end if it has none, as text files have it, so an empty text is one empty
    line; other bytes are as given."""
    spark = docs.sparkSession
    store = Store(spark, root)
    staging, own = f"{store.root}/_staging-{uuid.uuid4().hex}", F.col(path)
    rows = docs.where(own.isNotNull()).select(own.alias("path"), F.coalesce(F.col(content), F.lit("")).alias("text"))
    bare = F.ltrim(F.col("path"), F.lit("/"))
    depth = F.aggregate(F.split(bare, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), _step)["low"]
    rows = rows.withColumn("low", depth).withColumn("path", F.substring(paths.absolute(bare, ""), 2, 1 << 20))
    one = rows.groupBy("path").agg(F.max("text").alias("text"), F.min("low").alias("low"))
    named = one.select(F.sha2("path", 256).alias("name"), "path", F.regexp_replace("text", "\n\\z", "").alias("value"), "low")
    try:
        # Written once: `docs` is not run again for the paths, and their number says how many tasks make files.
        named.write.parquet(f"{staging}/rows")
        named = spark.read.schema(named.schema).parquet(f"{staging}/rows")
        if bad := named.where((F.col("low") < 0) | (F.col("path") == "")).select("path").first():
            raise OutsideRoot(f"{bad['path']!r} is outside {root}")
        n = named.count()
        # A file costs the same whatever its length, so tasks are dealt by files and not by bytes.
        named = named.repartition(max(4 * spark.sparkContext.defaultParallelism, n // WINDOW), "name")
        if (top := store.disk()) is not None:
            texts = f"{top}/{staging.rpartition('/')[2]}/text"
            named.select("name", F.col("value").cast("binary").alias("value")).foreachPartition(partial(_put, texts))
            named.select("name", "path").foreachPartition(partial(_place, texts, top))
            return n
        # Nobody reads the staging folder before the job has ended, so tasks put their files there themselves (algorithm 2).
        texts = named.select("name", "value").write.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
        texts.partitionBy("name").text(f"{staging}/text")
        return _moved(store, f"{staging}/text", named.select("name", "path"))
    finally:
        store.remove(staging)


def _step(state, step):
    at = F.when(step.isin("", "."), state["at"]).when(step == "..", state["at"] - 1).otherwise(state["at"] + 1)
    return F.struct(at.alias("at"), F.least(state["low"], at).alias("low"))


def _put(folder: str, rows: Iterator[Row]) -> None:
    """Texts as files named by their digests. Attempts of a task may meet: each file appears whole."""
    for row in rows:
        at = f"{folder}/{row['name'][:2]}"
        os.makedirs(at, exist_ok=True)
        aside = f"{at}/{uuid.uuid4().hex}.tmp"
        with open(aside, "wb") as f:
            f.write(row["value"])
            f.write(b"\n")
        os.replace(aside, f"{at}/{row['name']}")


def _place(folder: str, top: str, rows: Iterator[Row]) -> None:
    """Those files at their paths. What an earlier attempt of the task has placed already is left. A checksum that Hadoop keeps
    beside a replaced file goes with it."""
    for row in rows:
        target = f"{top}/{row['path']}"
        parent, _, name = target.rpartition("/")
        os.makedirs(parent, exist_ok=True)
        with suppress(FileNotFoundError):
            os.remove(f"{parent}/.{name}.crc")
        try:
            os.replace(f"{folder}/{row['name'][:2]}/{row['name']}", target)
        except FileNotFoundError:
            if not os.path.isfile(target):
                raise


def _moved(store: Store, staged: str, names: DataFrame) -> int:
    made: set[str] = set()

    def move(row) -> None:
        target = f"{store.root}/{row['path']}"
        folder = target.rpartition("/")[0]
        if folder not in made:
            store.make(folder)
            made.add(folder)
        store.move_only(f"{staged}/name={row['name']}", target)

    n, rows = 0, names.toLocalIterator(prefetchPartitions=True)
    with ThreadPoolExecutor(AT_ONCE) as pool:
        while window := list(islice(rows, WINDOW)):
            n += len(list(pool.map(move, window)))
            if len(made) > WINDOW:
                made.clear()
    return n
