"""A table of Parquet folders behind a manifest: appends, resets and upserts become visible as a whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.stores import Store

BUCKETS = 64


class Conflict(Exception):
    """Another writer was faster, again and again."""


class VersionedTable:
    """Rows below `path`. Version v is the file `_versions/<v>.json`, which names the folders of the rows; its appearing is the
    commit. Folders are never changed, so who reads version v goes on reading it while others are made. A writer that
    gives its name and a batch number commits each batch once, however often it is run. Folders that no version names, left
    by attempts that failed, are removed by `vacuum`."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.store = Store(spark, self.path)

    def versions(self) -> list[int]:
        return sorted(int(x[:-5]) for x in self.store.names(f"{self.path}/_versions") if x.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """What a version holds; of the latest one if none is given. Before the first commit: version 0, no rows."""
        if version is None:
            version = max(self.versions(), default=0)
        if version == 0:
            return {"version": 0, "folders": [], "rows": 0, "writers": {}}
        return json.loads(self.store.text(f"{self.path}/_versions/{version:020d}.json"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version)["folders"])

    def _rows(self, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f["path"] for f in folders))

    def _commit(self, change: Callable[[dict], list[dict] | None], writer: str | None, batch: int | None, tries: int = 20) -> int:
        """Apply `change` to the latest manifest's folders and commit the next version; on a conflict again, on the newer one."""
        for _ in range(tries):
            now = self.manifest()
            if writer is not None and now["writers"].get(writer, -1) >= batch:
                return now["version"]
            folders = change(now)
            if folders is None:
                return now["version"]
            then = {"version": now["version"] + 1, "folders": folders, "rows": sum(f["rows"] for f in folders), "writers": now["writers"] | ({} if writer is None else {writer: batch})}
            if self.store.put_new(f"{self.path}/_versions/{then['version']:020d}.json", json.dumps(then)):
                return then["version"]
        raise Conflict(self.path)

    def _written(self, df: DataFrame, *by: str) -> str:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        (df.write.partitionBy(*by) if by else df.write).parquet(folder)
        return folder

    def _counted(self, folder: str) -> dict:
        return {"path": folder, "rows": self.spark.read.schema(self.schema).parquet(folder).count()}

    def append(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """The rows of `df` after those that are there."""
        new = self._counted(self._written(df))
        return self._commit(lambda now: [*now["folders"], new] if new["rows"] else None, writer, batch)

    def reset(self, df: DataFrame, writer: str | None = None, batch: int | None = None) -> int:
        """The rows of `df` in place of all others."""
        new = self._counted(self._written(df))
        return self._commit(lambda now: [new], writer, batch)

    def appended_after(self, make: Callable[[int], DataFrame], writer: str | None = None, batch: int | None = None) -> int:
        """Append `make(n)`, where n is the number of rows before them; made anew if others append meanwhile."""
        made: dict[int, dict] = {}

        def change(now: dict) -> list[dict] | None:
            n = now["rows"]
            if n not in made:
                made[n] = self._counted(self._written(make(n)))
            return [*now["folders"], made[n]] if made[n]["rows"] else None

        return self._commit(change, writer, batch)

    def upsert(self, df: DataFrame, key: str, writer: str | None = None, batch: int | None = None, buckets: int = BUCKETS) -> int:
        """Rows of `df` (one a key) in place of those with their key. Only the buckets of these keys are rewritten; the
        others' folders are named again. A table is upserted with one number of buckets, always."""

        def bucket(c: Column) -> Column:
            return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")

        new = df.select(*self.spark.createDataFrame([], self.schema).columns)
        counts = {r["_bucket"] for r in new.select(bucket(F.col(key)).alias("_bucket")).distinct().collect()}  # `buckets` at most

        def change(now: dict) -> list[dict] | None:
            if not counts:
                return None
            if any(f.get("buckets", buckets) != buckets for f in now["folders"]):
                raise ValueError(f"this table has {now['folders'][0]['buckets']} buckets")
            old = self._rows([f for f in now["folders"] if f["bucket"] in counts])
            kept = old.join(new.select(key).hint("merge"), key, "left_anti").select(*new.columns)
            folder = self._written(kept.unionByName(new).withColumn("_bucket", bucket(F.col(key))).repartition("_bucket"), "_bucket")
            sizes = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(folder).groupBy("_bucket").count().collect()
            rewritten = [{"path": f"{folder}/_bucket={r['_bucket']}", "rows": r["count"], "bucket": r["_bucket"], "buckets": buckets} for r in sizes]
            return [*(f for f in now["folders"] if f["bucket"] not in counts), *rewritten]

        return self._commit(change, writer, batch)

    def compact(self) -> int:
        """All appended rows in one folder, if no other version comes between."""
        now = self.manifest()
        new = self._counted(self._written(self.read(now["version"])))
        return self._commit(lambda latest: [new] if latest["version"] == now["version"] else None, None, None)

    def vacuum(self, keep: int = 2) -> None:
        """Forget all but the latest `keep` versions, and remove folders that none of these names. Not while a writer is at work."""
        held = self.versions()[-keep:]
        named = {f["path"].split("/data/")[1].split("/")[0] for v in held for f in self.manifest(v)["folders"]}
        for v in self.versions():
            if v not in held:
                self.store.remove(f"{self.path}/_versions/{v:020d}.json")
        for folder in self.store.names(f"{self.path}/data"):
            if folder not in named:
                self.store.remove(f"{self.path}/data/{folder}")
