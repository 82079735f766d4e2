"""Session helpers: the shared work folder and tables written to cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: `spark.checkpoint.dir`; where it is unset (it can't be set later), a
    folder in the warehouse, which they share too."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_tapeline"
    return path.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/tapeline/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: later stages restart from the files."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once per application: their Python needs no copy of the repository."""
    app, root = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app in _shipped or not root.is_dir():
        return
    archive = Path(tempfile.mkdtemp(prefix="tapeline-")) / "tapeline.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, Path(root.name) / file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


def resource(name: str, fallback: str | Path | None = None) -> str | None:
    """Where a file that a run needs lies, on the driver or in a task: among the files that Spark has given out
    (`spark.sparkContext.addFile`), else in the folder `fallback`, as in a checkout. None if it is in neither."""
    try:
        given = Path(SparkFiles.get(name))
        if given.exists():
            return str(given)
    except Exception:  # outside Spark there are no such files
        pass
    own = None if fallback is None else Path(fallback) / name
    return str(own) if own is not None and own.exists() else None
