"""The queue between a run and what shows it: events in order, drained on a timer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tapeline.functions import loglines
from tapeline.sinks.versioned import VersionedTable
from tapeline.streaming.logs import POLL

EVENT = "run {run}, seq long, kind string, payload string"
LOG = "run {run}, seq long, level string, message string"
STATE = "run {run}, status string, progress string, done boolean, seq long"


def shown(events: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """What is shown of each run after `events` (EVENT): the last status with its progress, whether the run is done, and the last
    event's number; of runs in `known` (STATE) what has no newer event stays."""
    status, progress = loglines.split_once(F.col("payload"))
    said = (F.col("kind") == "status") & F.col("payload").isNotNull()
    rows = events.select("run", "seq", F.when(said, F.struct("seq", status.alias("status"), progress.alias("progress"))).alias("s"), (F.col("kind") == "done").alias("done"))
    if known is not None:
        # What was known comes before all events.
        before = F.struct(F.lit(-1).cast("long").alias("seq"), "status", "progress")
        rows = rows.unionByName(known.join(events.select("run").distinct(), "run").select("run", "seq", F.when(F.col("status").isNotNull(), before).alias("s"), "done"))
    last = rows.groupBy("run").agg(F.max("s").alias("s"), F.max("done").alias("done"), F.max("seq").alias("seq"))
    return last.select("run", "s.status", "s.progress", "done", "seq")


def messages(events: DataFrame) -> DataFrame:
    """The log rows of `events`: run, seq, level, message. Payloads without a level or message, and null ones, are none."""
    level, message = loglines.split_once(F.col("payload"))
    return events.where("kind = 'log' and payload is not null").select("run", "seq", level.alias("level"), message.alias("message")).where("message is not null")


def drained(queue: DataFrame, log: VersionedTable, state: VersionedTable, checkpoint: str, once: bool = False, poll: str = POLL, buckets: int = 16) -> StreamingQuery:
    """Every `poll` take what the queue holds (or, with `once`, all that it holds and stop): log rows are appended to `log` as one
    version a batch, and the runs' rows in `state` replaced. The queue is in order: a batch's events come after those of the
    batches before; within a batch they are put in order by `seq`."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            log.append(messages(batch), writer=checkpoint, batch=number)
            state.upsert(shown(batch, state.read()), "run", writer=checkpoint, batch=number, buckets=buckets)
        finally:
            batch.unpersist()

    writer = queue.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()
