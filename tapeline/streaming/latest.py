"""The last row of each key, kept as a stream goes on: progress cells, documents that overwrite each other, running selections."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tapeline.operators.ordering import with_index
from tapeline.sinks.versioned import VersionedTable
from tapeline.streaming.state import disk_state

#: Buckets of keys, and the bytes of a key's digest.
BUCKETS, WIDTH = 1 << 14, 32
BUCKET, DIGEST, DIGESTS = "_bucket", "_digest", "_digests"


def _fields(df: DataFrame, names: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{n}` {kinds[n]}" for n in names)


class LastRow(StatefulProcessor):
    """Holds each key's row of greatest `order` (of equals, the first that came) and how many rows came. What it emits are rows
    that changed; in one batch, the last for each key. With `idle`, an event-time timer closes a key `idle` seconds after the
    time of its latest row, once the watermark has passed: it emits the row as closed and forgets the key."""

    def __init__(self, key: str, order: str, names: list[str], fields: str, time: str | None = None, idle: float | None = None):
        self.order, self.names, self.fields, self.time, self.idle = order, names, fields, time, idle
        self.out = Row(key, *names, "overwritten", "closed")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("cell", f"{self.fields}, came long, closes long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.cell.get()
        *best, came, closes = held if held is not None else (*(None,) * len(self.names), 0, 0)
        at, known, latest = self.names.index(self.order), came, closes
        for row in rows:
            came += 1
            if came == 1 or row[self.order] > best[at]:
                best = [row[n] for n in self.names]
            if self.idle is not None:
                latest = max(latest, int((row[self.time].replace(tzinfo=timezone.utc).timestamp() + self.idle) * 1000))
        if self.idle is not None and latest > closes:
            if closes:
                self.handle.deleteTimer(closes)
            self.handle.registerTimer(latest)
        self.cell.update((*best, came, latest))
        if came > known:
            yield self.out(*key, *best, came - 1, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        *best, came, _ = self.cell.get()
        self.cell.clear()
        yield self.out(*key, *best, came - 1, True)

    def close(self) -> None: ...


def keep_last(stream: DataFrame, key: str, order: str, time: str | None = None, idle: float | None = None) -> DataFrame:
    """Changes to the last row of each `key`: all columns, `overwritten` (rows of that key that lost) and `closed`. With `idle`
    (seconds), `stream` needs a watermark on `time`; later rows of a closed key that pass the watermark open it anew."""
    names = [n for n in stream.columns if n != key]
    fields = _fields(stream, names)
    mode = "None" if idle is None else "EventTime"
    return stream.groupBy(key).transformWithState(LastRow(key, order, names, fields, time, idle), f"{_fields(stream, [key])}, {fields}, overwritten long, closed boolean", "Update", mode)


class FirstSeen(StatefulProcessor):
    """Emits each key once: of the first batch that has it, the row of least `order`; keys of the initial state never. Each call for
    state goes to the JVM and back, so a key of the state is a bucket of keys, and its value their digests, one after the other, for
    ever: two calls a bucket and batch."""

    def __init__(self, order: str, names: list[str]):
        self.order, self.names, self.out = order, names, Row(*names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "digests binary")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.seen.update((bytes(initialState[DIGESTS]),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.seen.get()
        held = b"" if state is None else bytes(state[0])
        seen = {held[i : i + WIDTH] for i in range(0, len(held), WIDTH)}
        best: dict[bytes, Row] = {}
        for row in rows:
            digest = bytes(row[DIGEST])
            if digest not in seen and (digest not in best or row[self.order] < best[digest][self.order]):
                best[digest] = row
        if best:
            self.seen.update((held + b"".join(best),))
        for row in best.values():
            yield self.out(*(row[n] for n in self.names))

    def close(self) -> None: ...


def first_seen(stream: DataFrame, key: str, order: str, known: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of `stream` whose `key` neither `known` (one column) nor an earlier batch had, one a key. Keys, as texts, meet by their
    SHA-256; null is a key. `known` is read when a checkpoint begins, and not again; a checkpoint holds for one number of buckets."""

    def dealt(df: DataFrame, of: str) -> DataFrame:
        digest = F.coalesce(F.unhex(F.sha2(F.col(of).cast("string"), 8 * WIDTH)), F.unhex(F.lit("00" * WIDTH)))
        return df.withColumn(DIGEST, digest).withColumn(BUCKET, F.pmod(F.xxhash64(DIGEST), F.lit(buckets)).cast("int"))

    first = None
    if known is not None:
        whole = F.unhex(F.array_join(F.collect_set(F.hex(DIGEST)), ""))
        first = dealt(known.toDF("key"), "key").groupBy(BUCKET).agg(whole.alias(DIGESTS)).groupBy(BUCKET)
    return dealt(stream, key).groupBy(BUCKET).transformWithState(FirstSeen(order, stream.columns), _fields(stream, stream.columns), "Append", "None", first)


def _run(changes: DataFrame, checkpoint: str, mode: str, each: Callable[[DataFrame, int], object], once: bool, poll: str) -> StreamingQuery:
    def once_run(batch: DataFrame, number: int) -> None:
        # `each` reads a batch several times, and without this its keys would go through their state each time.
        batch.persist()
        try:
            each(batch, number)
        finally:
            batch.unpersist()

    with disk_state(changes.sparkSession):
        writer = changes.writeStream.outputMode(mode).foreachBatch(once_run).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=poll)).start()


def upserted(changes: DataFrame, table: VersionedTable, key: str, checkpoint: str, once: bool = True, poll: str = "150 milliseconds", **options) -> StreamingQuery:
    """Write each batch's changes into `table`, where only the buckets of changed keys are rewritten. Batches that run again after a
    failure are known by their number and change nothing."""

    def each(batch: DataFrame, number: int) -> None:
        table.upsert(batch, key, writer=checkpoint, batch=number, **options)

    return _run(changes, checkpoint, "update", each, once, poll)


def selected(chosen: DataFrame, table: VersionedTable, key: str, order: str, checkpoint: str, existing: DataFrame | None = None, once: bool = True, poll: str = "150 milliseconds") -> StreamingQuery:
    """An ordered selection that grows: rows whose `key` isn't selected yet (`existing`: what `table` held at first) are appended to `table` in the order of the batches
    and, within one, of `order`, with a running `file_index`. Keys meet by their SHA-256, which the state keeps; rows without a key are not files and go."""
    known = None if existing is None else existing.where(F.col(key).isNotNull()).select(key)
    fresh = first_seen(chosen.where(F.col(key).isNotNull()), key, order, known)

    def each(batch: DataFrame, number: int) -> None:
        table.appended_after(lambda n: with_index(batch, order, first=n + 1), writer=checkpoint, batch=number)

    return _run(fresh, checkpoint, "append", each, once, poll)
