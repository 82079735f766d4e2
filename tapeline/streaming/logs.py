"""Log lines as a stream: split, routed to two outputs, the latest progress kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeline.operators import logs

POLL = "150 milliseconds"


def read_lines(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Lines of the text files that appear in a folder: `value`, and `file` and `at` of each."""
    rows = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return rows.select("value", F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_modification_time").alias("at"))


def transform(stream: DataFrame, column: str = "value") -> DataFrame:
    """What the batch operators do, on a stream."""
    return logs.routed(logs.split_lines(stream, column))


def write_both(stream: DataFrame, log_path: str, progress_path: str, checkpoint: str, key: str, seq: str, once: bool = True) -> StreamingQuery:
    """Append log rows to one table and each micro-batch's latest progress to another."""

    def both(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again after a failure overwrites what it wrote before.
        batch.persist()
        try:
            logs.log_rows(batch).write.mode("overwrite").parquet(f"{log_path}/batch={batch_id}")
            logs.latest(batch.where("route = 'progress'"), key, seq).write.mode("overwrite").parquet(f"{progress_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=POLL)).start()


def ready(spark: SparkSession) -> DataFrame:
    """What a log holds after a reset."""
    return spark.createDataFrame([("info", "Ready.")], "kind string, message string")


def reset_log(spark: SparkSession, path: str) -> None:
    """One row `Ready.` in place of the log. While it runs, readers of the folder may find nothing; a `VersionedTable` has no
    such moment."""
    ready(spark).write.mode("overwrite").parquet(path)
