"""Lists of media files."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import kinds, paths
from tapeline.operators.ordering import with_index
from tapeline.schemas import MEDIA_FILE


def described(df: DataFrame) -> DataFrame:
    """file_index, path, name, folder from file_index and path."""
    return df.select("file_index", "path", paths.name(F.col("path")).alias("name"), paths.folder(F.col("path")).alias("folder"))


def from_paths(spark: SparkSession, files: Sequence[str], base: str | None = None) -> DataFrame:
    """A list given in order, as command-line options are; paths are made absolute from `base` (the working folder)."""
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(files, 1)], "file_index long, path string")
    rows = rows.withColumn("path", paths.absolute(F.col("path"), base or os.getcwd()))
    return described(rows).to(spark.createDataFrame([], MEDIA_FILE).schema)


def list_media(spark: SparkSession, folder: str, recursive: bool = True, every_file: bool = False) -> DataFrame:
    """Media files below a folder of any store, by path; only names are read. Extensions match in any case."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder).select("path")
    if not every_file:
        found = found.where(paths.is_media(F.col("path")))
    return described(with_index(found, "path"))


#: Schemes of stores that Arrow opens by itself, so that a task reads a range of a file only.
RANGED = ("file", "s3", "gs", "gcs", "abfs", "abfss")


def with_heads(files: DataFrame, n: int = kinds.HEAD) -> DataFrame:
    """`files` (path) with `head`, their first `n` bytes. On stores that Arrow opens a task reads these bytes only; on others Spark
    reads the files whole and keeps as many. Files that can't be read have a null head."""
    scheme = F.coalesce(F.nullif(F.regexp_extract("path", "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.lit("")), F.lit("file"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            heads = []
            for path in batch.column("path").to_pylist():
                try:
                    store, at = fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)
                    with store.open_input_file(at) as f:
                        heads.append(f.read(n))
                except (OSError, pa.ArrowInvalid):
                    heads.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.binary())], [*batch.schema.names, "head"])

    schema = ", ".join(f"`{c}` {t}" for c, t in files.dtypes) + ", head binary"
    here = files.where(scheme.isin(*RANGED)).mapInArrow(read, schema)
    there = files.where(~scheme.isin(*RANGED))
    names = [r["path"] for r in there.select(F.regexp_extract("path", "^(.*)/", 1).alias("path")).distinct().limit(10_001).collect()]
    if not names:
        return here
    if len(names) > 10_000:
        raise ValueError("files of more than 10,000 folders of a store that Arrow doesn't open")
    whole = files.sparkSession.read.format("binaryFile").load(names).select("path", F.substring("content", 1, n).alias("head"))
    return here.unionByName(there.join(whole, "path", "left").select(*files.columns, "head"))


def by_content(files: DataFrame) -> DataFrame:
    """`files` that are media by their first bytes, whatever their names, with their `kind`."""
    found = with_heads(files)
    return found.withColumn("kind", kinds.kind(F.col("head"))).where("kind is not null").drop("head")
