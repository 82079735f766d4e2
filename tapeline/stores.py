"""Small files and folders on any store that Spark can open, through Hadoop's file system, from the driver."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Store:
    """The file system of `root`. Data are read and written by Spark; here are only names and small texts."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root.rstrip("/")
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        at = self.path(self.root)
        self.fs, self.files = at.getFileSystem(conf), self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), conf)
        self._rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        self._gateway = spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def disk(self) -> str | None:
        """The root's plain path if the store is a disk (`file:`), which tasks reach without Hadoop too; else None."""
        uri = self.fs.makeQualified(self.path(self.root)).toUri()
        return uri.getPath() if uri.getScheme() == "file" else None

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        """Names in a folder; none if it isn't there."""
        return [f.getPath().getName() for f in self.fs.listStatus(self.path(folder))] if self.exists(folder) else []

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self.path(folder))

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            words = self.jvm.java.util.Scanner(stream, "UTF-8").useDelimiter("\\A")
            return words.next() if words.hasNext() else ""
        finally:
            stream.close()

    def move(self, source: str, target: str, overwrite: bool = True) -> bool:
        """Rename in one step. False if the target is there and isn't to be replaced."""
        how = self._gateway.new_array(self._rename, 1)
        how[0] = self._rename.OVERWRITE if overwrite else self._rename.NONE
        try:
            self.files.rename(self.path(source), self.path(target), how)
        except Py4JJavaError as e:
            if not overwrite and "FileAlreadyExistsException" in str(e.java_exception):
                return False
            raise
        return True

    def move_only(self, folder: str, target: str) -> None:
        """Rename the one file of `folder`, in one step, replacing what file is at `target`. A plain rename where the name is
        free: `move` asks for links first."""
        (found,) = self.fs.listStatus(self.path(folder))
        source, at = found.getPath(), self.path(target)
        if not self.fs.isDirectory(at):  # a plain rename would put the file inside
            with suppress(Py4JJavaError):  # some stores raise, others say no, where a file is in the way
                if self.fs.rename(source, at):
                    return
        self.move(source.toString(), target)

    def put_new(self, name: str, text: str) -> bool:
        """Write a small file that appears whole or not at all; False if the name is taken."""
        aside = f"{name}.{uuid.uuid4().hex}.tmp"
        self.make(name.rpartition("/")[0])
        stream = self.fs.create(self.path(aside), False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        try:
            return self.move(aside, name, overwrite=False)
        finally:
            self.remove(aside)


class Running(ValueError):
    """A run is going on in that folder."""


@contextmanager
def sole_run(spark: SparkSession, folder: str, stale_after: float = 24 * 3600) -> Iterator[str]:
    """Hold `folder` for one run: whoever comes meanwhile, from whatever application, gets `Running`. The mark is a small file that
    only one can make; a run that was killed leaves it, and it counts no longer after `stale_after` seconds."""
    store, owner = Store(spark, folder), uuid.uuid4().hex
    mark = f"{store.root}/_running"
    if store.exists(mark):
        since, _, by = store.text(mark).partition(" ")
        if time.time() - float(since) < stale_after:
            raise Running(f"a run is going on in {folder}, by {by}")
        # Of several that find the mark stale, the one whose rename succeeds removes it.
        if store.move(mark, f"{mark}-{by}", overwrite=False):
            store.remove(f"{mark}-{by}")
    if not store.put_new(mark, f"{time.time()} {owner}"):
        raise Running(f"a run is going on in {folder}")
    try:
        yield owner
    finally:
        if store.exists(mark) and store.text(mark).endswith(owner):
            store.remove(mark)
