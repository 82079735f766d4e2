"""Exact deduplication by a stateful stream: RocksDB keeps digest, stable identifier and content locator for ever.

Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Of equal texts the row with
the largest doc_id stays; rows that also share the doc_id are told apart by their locator (file, row in file), so one
row of a group stays, never two. A null doc_id counts as smaller than any other. Empty table: no rows.

The stream carries fingerprints only (about 60 bytes a row), never texts. Its state is the set of digests seen so far;
it has no watermark, hence no expiry, and a later batch of files continues from the same checkpoint. A row whose digest
the state holds under another row is a hit: its full normalised text is compared with the full text of the row that
stays, read through the locator. Should texts differ under one digest, those rows are grouped by the text itself.

Skew: state is built by partial aggregates, so a digest of a third of all rows costs one row per task. The joins on
the digest are inner or left sort-merge joins whose large side adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tapeline.llm.common import ascii_lower, without
from tapeline.session import materialise, work_path

STATE = "spark.sql.streaming.stateStore."
#: The state is on disk; an executor's stores share a bounded amount of memory, and each closes when its task has committed
#: (an open one reserves 4 MB of disk whatever it holds).
STATE_CONF = {
    STATE + "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    STATE + "rocksdb.boundedMemoryUsage": "true",
    STATE + "rocksdb.maxMemoryUsageMB": "256",
    STATE + "rocksdb.writeBufferSizeMB": "8",
    STATE + "maintenanceInterval": "5s",
    STATE + "unloadOnCommit": "true",
}


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def located(docs: DataFrame) -> tuple[DataFrame, Column]:
    """`docs` and a column with each row's place, (file, row): hidden file metadata, or files written for it."""
    def of(df: DataFrame) -> Column:
        hidden = df.metadataColumn("_metadata")
        place = F.struct(F.xxhash64(hidden["file_path"]).alias("file"), hidden["row_index"].alias("row"))
        df.select(place)
        return place

    try:
        return docs, of(docs)
    except AnalysisException:
        docs = materialise(docs, "dedup-input")
        return docs, of(docs)


def fingerprints(docs: DataFrame, place: Column, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per document: digest, stable identifier, locator."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), digest(normalised(F.col("text"))).alias("digest")
    ).select("doc_id", "place", "digest")


def remember(spark: SparkSession, prints_path: str, schema, checkpoint: str, bytes_per_batch: int = 4 << 30) -> DataFrame:
    """Run the stream over the fingerprint files not seen before; return its whole state (digest, keeper, n).

    Call it again with the same `checkpoint` after files were added: state continues, only new files are read."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        seen = (
            spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_per_batch).parquet(prints_path)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "place")).alias("keeper"), F.count(F.lit(1)).alias("n"))
        )
        query = (
            seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
        keeper, n = (f.name for f in state.schema["value"].dataType.fields)
        columns = F.col("key.digest").alias("digest"), F.col("value")[keeper].alias("keeper"), F.col("value")[n].alias("n")
        return materialise(state.select(*columns), "dedup-seen")
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def resolve(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """doc_id, place, digest, keep_id, group_size, kept for every row of `docs`."""
    spark = docs.sparkSession
    docs, place = located(docs)
    path = work_path(spark, "dedup-prints")
    prints = fingerprints(docs, place, digest)
    prints.write.parquet(path)
    prints = spark.read.schema(prints.schema).parquet(path)
    state = remember(spark, path, prints.schema, work_path(spark, "dedup-state"))

    # Full bytes of the rows that share a digest, against those of the row that stays.
    shared = state.where("n > 1")
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), normalised(F.col("text")).alias("body"))
    hits = prints.join(shared, "digest").select("digest", "doc_id", "place", "keeper", "n")
    kept_text = shared.select(F.col("keeper.place").alias("place"), "digest").join(full, "place").select("digest", F.col("body").alias("kept_body"))
    checked = materialise(
        hits.where("place != keeper.place")
        .join(full.select("place", "body"), "place")
        .join(kept_text, "digest")
        .select("digest", "place", "doc_id", (F.col("body") == F.col("kept_body")).alias("same"), F.when(F.col("body") != F.col("kept_body"), F.col("body")).alias("other")),
        "dedup-checked",
    )
    # Rows of one digest with another text: grouped by that text. Empty unless the digest collides.
    odd = checked.where("not same")
    odd_groups = odd.groupBy("digest", "other").agg(F.max(F.struct("doc_id", "place")).alias("keeper"), F.count(F.lit(1)).alias("n"))
    odd_rows = odd.join(odd_groups, ["digest", "other"]).select("place", F.col("keeper").alias("odd_keeper"), F.col("n").alias("odd_n"))
    odd_counts = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("away"))
    if odd.isEmpty():
        grouped = prints.join(state, "digest")
    else:
        grouped = (
            prints.join(state, "digest").join(odd_counts, "digest", "left").join(odd_rows, "place", "left")
            .withColumn("n", F.coalesce("odd_n", F.col("n") - F.coalesce("away", F.lit(0))))
            .withColumn("keeper", F.coalesce("odd_keeper", "keeper"))
        )
    return grouped.select(
        "doc_id", "place", "digest", F.col("keeper.doc_id").alias("keep_id"), F.col("n").cast("long").alias("group_size"),
        (F.col("place") == F.col("keeper.place")).alias("kept"),
    )


def exact_dedup(docs: DataFrame, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256."""
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    if digest is sha256:
        return resolve(docs, digest).select(*columns, F.col("digest").alias("text_sha256"))
    docs, place = located(docs)
    shas = docs.select(place.alias("place"), sha256(normalised(F.col("text"))).alias("text_sha256"))
    return resolve(docs, digest).join(shas, "place").select(*columns, "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    docs, place = located(docs)
    return without(docs, place, resolve(docs).where("not kept").select("place"))
