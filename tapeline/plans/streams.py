"""Queries that run as streams with state, restarted half way, and end in tables; their SQL is that of the batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.functions import loglines, paths
from tapeline.operators import logs
from tapeline.plans.adapters import event_lines, table
from tapeline.plans.catalogue import ORACLE, ROUTED, query, routed_events, selection_tables
from tapeline.session import work_path
from tapeline.sinks.versioned import VersionedTable
from tapeline.streaming import latest, pipes, queue
from tapeline.streaming.logs import ready
from tapeline.streaming.state import disk_state


def _halves(df: DataFrame, *key: Column | str) -> tuple[DataFrame, DataFrame]:
    """Two halves by a hash, so that rows of one come before rows of the other whatever their order."""
    late = F.pmod(F.xxhash64(*key), F.lit(2)) == 1
    return df.where(~late), df.where(late)


@query(ORACLE["log_lines"])
def lines_reassembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a byte pipe: cut anywhere, half of the chunks out of order, over a restart; its lines again."""
    source, out, checkpoint = (work_path(spark, f"pipes-{x}") for x in ("chunks", "lines", "checkpoint"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    for half in _halves(pipes.chunked(docs, "doc_id", F.encode("text", "UTF-8")), "pipe", "at"):
        half.write.mode("append").parquet(source)
        with disk_state(spark):
            stream = pipes.lines(pipes.read_chunks(spark, source))
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    line = loglines.cleaned(F.col("line"))
    rows = spark.read.schema("pipe long, line_no long, line string").parquet(out)
    return rows.select(F.col("pipe").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"), line.alias("line")).where("line <> ''")


@query(ORACLE["progress_latest"])
def progress_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The progress cell of each user as keyed state, its changes upserted; events out of order, over a restart."""
    source, checkpoint = work_path(spark, "cell-lines"), work_path(spark, "cell-checkpoint")
    cells = VersionedTable(spark, work_path(spark, "cells"), "user_id long, message string, event_id long")
    events = routed_events(spark, sf_dir).where("route = 'progress'").select("user_id", "event_id", "message")
    for half in _halves(events, "event_id"):
        half.write.mode("append").parquet(source)
        stream = spark.readStream.schema("user_id long, event_id long, message string").parquet(source)
        latest.upserted(latest.keep_last(stream, "user_id", "event_id"), cells, "user_id", checkpoint, buckets=16).awaitTermination()
    return cells.read()


@query(ORACLE["output_keep_last"])
def keep_last_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last writer of each output path as keyed state; the table is rewritten where it changed only."""
    source, checkpoint = work_path(spark, "writers"), work_path(spark, "writers-checkpoint")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", paths.target(F.col("url"), F.lit("/out")).alias("output_path"))
    out = VersionedTable(spark, work_path(spark, "written"), "output_path string, page_id long, url string, overwritten long")
    for half in _halves(rows, "page_id"):
        half.write.mode("append").parquet(source)
        stream = spark.readStream.schema("page_id long, url string, output_path string").parquet(source)
        latest.upserted(latest.keep_last(stream, "output_path", "page_id"), out, "output_path", checkpoint, buckets=16).awaitTermination()
    return out.read()


@query(ORACLE["selection_union"])
def selection_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of files that arrive one after the other; those not selected before are added, the index runs on."""
    source, checkpoint = work_path(spark, "lists"), work_path(spark, "lists-checkpoint")
    existing, chosen = selection_tables(spark, sf_dir)
    kept = VersionedTable(spark, work_path(spark, "selection"), "doc_id long, text string, file_index long")
    kept.append(latest.with_index(existing, "doc_id").select("doc_id", "text", "file_index"))
    ends = chosen.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).first()
    late = F.col("doc_id") > ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    for part in (chosen.where(~late), chosen.where(late)):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema("doc_id long, text string").parquet(source)
        latest.selected(stream, kept, "text", "doc_id", checkpoint, existing=existing).awaitTermination()
    return kept.read().select("doc_id", "file_index")


@query(ROUTED + "SELECT kind, message, count(*) AS n FROM r WHERE route = 'log' AND event_id % 2 = 1 GROUP BY kind, message UNION ALL SELECT 'info', 'Ready.', 1")
def log_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is appended to, reset to its one row, and appended to again; a writer that runs twice counts once."""
    log = VersionedTable(spark, work_path(spark, "log-table"), "kind string, message string")
    rows = logs.log_rows(routed_events(spark, sf_dir))
    log.append(rows.where("event_id % 2 = 0").select("kind", "message"))
    log.reset(ready(spark))
    for _ in range(2):
        log.append(rows.where("event_id % 2 = 1").select("kind", "message"), writer="events", batch=0)
    return log.read().groupBy("kind", "message").agg(F.count(F.lit(1)).alias("n"))


_QUEUE = """
WITH q AS (
  SELECT user_id AS run, event_id AS seq, CASE event_type WHEN 'view' THEN 'status' WHEN 'signup' THEN 'done' ELSE 'log' END AS kind,
         CASE WHEN event_type <> 'signup' THEN event_type || '|' || CAST(event_id AS VARCHAR) || '|' || CAST(floor(value) AS VARCHAR) END AS payload FROM events
), s AS (SELECT run, arg_max(payload, seq) FILTER (WHERE kind = 'status') AS p, bool_or(kind = 'done') AS done, max(seq) AS seq, count(*) FILTER (WHERE kind = 'log') AS logged FROM q GROUP BY run)
SELECT run, substr(p, 1, position('|' IN p) - 1) AS status, substr(p, position('|' IN p) + 1) AS progress, done, seq, logged FROM s
"""


@query(_QUEUE)
def queue_drained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a queue, drained in two goes with a restart between: each run's status, its progress, and its log rows counted."""
    source, checkpoint = work_path(spark, "queue"), work_path(spark, "queue-checkpoint")
    log = VersionedTable(spark, work_path(spark, "queue-log"), queue.LOG.format(run="long"))
    state = VersionedTable(spark, work_path(spark, "queue-state"), queue.STATE.format(run="long"))
    event = F.col("event_type")
    kind = F.when(event == "view", "status").when(event == "signup", "done").otherwise("log")
    bar, whole = F.lit("|"), F.floor("value").cast("double").cast("string")
    payload = F.when(event != "signup", F.concat(event, bar, F.col("event_id").cast("string"), bar, whole))
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind.alias("kind"), payload.alias("payload"))
    ends = rows.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    late = F.col("seq") > ((ends["a"] or 0) + (ends["b"] or 0)) // 2
    for part in (rows.where(~late), rows.where(late)):
        part.write.mode("append").parquet(source)
        events = spark.readStream.schema(queue.EVENT.format(run="long")).parquet(source)
        queue.drained(events, log, state, checkpoint, once=True).awaitTermination()
    counts = log.read().groupBy("run").agg(F.count(F.lit(1)).alias("logged"))
    return state.read().join(counts, "run", "left").select("run", "status", "progress", "done", "seq", F.coalesce("logged", F.lit(0)).cast("long").alias("logged"))
