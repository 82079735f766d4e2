import random
import re
import sys
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tapeline.functions.text import LINE_BREAKS
from tapeline.operators import selection, transcript
from tapeline.sinks.versioned import VersionedTable
from tapeline.sources.pipes import outputs
from tapeline.streaming import latest, pipes
from tapeline.streaming.logs import ready
from tapeline.streaming.state import disk_state


def run_lines(spark, folder, out, checkpoint, files=1):
    with disk_state(spark):
        stream = pipes.lines(pipes.read_chunks(spark, folder, files_per_batch=files))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_lines_of_pipes_cut_anywhere(spark, tmp_path):
    """Characters of up to four bytes, every kind of line break, chunks of 0 to 5 bytes in any order, some twice, one pipe open,
    over restarts."""
    rng = random.Random(7)
    texts = {i: "".join(rng.choice(["a", "é", "日", "😀", " ", "\r\n", "\n", *LINE_BREAKS]) for _ in range(40)) for i in range(6)} | {6: "", 7: "one line"}
    rows = []
    for pipe, text in texts.items():
        data, at = text.encode(), 0
        while at < len(data):
            n = min(rng.randint(1, 5), len(data) - at)
            rows.append((pipe, at, bytearray(data[at : at + n])))
            if rng.random() < 0.2:  # again, and longer
                rows.append((pipe, at, bytearray(data[at : at + n + 2])))
            at += n
        if pipe != 5:
            rows.append((pipe, at, bytearray()))
    rng.shuffle(rows)
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in range(3):
        spark.createDataFrame(rows[part::3], pipes.CHUNK.format(pipe="long")).repartition(2).write.mode("append").parquet(source)
        run_lines(spark, source, out, checkpoint)
    got = {}
    for r in spark.read.parquet(out).collect():
        assert (r.pipe, r.line_no) not in got
        got[r.pipe, r.line_no] = r.line
    for pipe, text in texts.items():
        want = re.split(f"[{LINE_BREAKS}]", text)
        want = want[:-1] if pipe == 5 else want  # an open pipe's last line isn't whole
        assert [got.pop((pipe, i), None) for i in range(len(want))] == want
    assert not got


class Held:
    """State in plain Python, its calls counted."""

    def __init__(self):
        self.calls, self.all = 0, {}

    def getValueState(self, name, schema):
        return Cell(self, self.all.setdefault(name, {}))

    def getMapState(self, name, key, value):
        return Cell(self, self.all.setdefault(name, {}))


class Cell:
    def __init__(self, held, values):
        self.held, self.values = held, values

    def _call(self, f, *args):
        self.held.calls += 1
        return f(*args)

    get = lambda self: self._call(self.values.get, ())
    update = lambda self, v: self._call(self.values.__setitem__, (), v)
    clear = lambda self: self._call(self.values.clear)
    getValue = lambda self, k: self._call(self.values.__getitem__, k)
    updateValue = lambda self, k, v: self._call(self.values.__setitem__, k, v)
    removeKey = lambda self, k: self._call(self.values.pop, k)


def cut_up(rng, texts, least, most):
    rows = []
    for pipe, text in texts.items():
        data, at = text.encode(), 0
        while at < len(data):
            n = min(rng.randint(least, most), len(data) - at)
            rows.append(Row(pipe=pipe, at=at, chunk=data[at : at + n]))
            if rng.random() < 0.2:
                rows.append(Row(pipe=pipe, at=at, chunk=data[at : at + n + rng.randint(0, 4)]))
            at += n
        rows.append(Row(pipe=pipe, at=at, chunk=b""))
    rng.shuffle(rows)
    return rows


def taken(processor, batches):
    got = {}
    for batch in batches:
        for r in processor.handleInputRows((0,), iter(batch), None):
            for n, line in enumerate(r.lines, r.first):
                assert (r.pipe, n) not in got
                got[r.pipe, n] = line
    return got


@pytest.mark.parametrize("seed", range(20))
def test_pipes_of_a_bucket_that_hold_little_or_much(seed):
    """Whatever goes from a bucket's value to entries of its own and back, lines are those of the texts, and nothing stays."""
    rng = random.Random(seed)
    texts = {i: "".join(rng.choice(["a", "é", "日", "😀", "bcd" * rng.randint(1, 9), "\n", *LINE_BREAKS] if i % 3 else ["x", "日"]) for _ in range(rng.randint(0, 60))) for i in range(8)}
    rows, held = cut_up(rng, texts, 1, 6), Held()
    processor = pipes.Reassembler("bigint", held=rng.choice([0, 5, 40]), block=rng.choice([1, 7, 64]))
    processor.init(held)
    n = rng.choice([1, 3, 12, len(rows)])
    assert taken(processor, [*(rows[i::n] for i in range(n)), rows]) == {(p, i): x for p, text in texts.items() for i, x in enumerate(re.split(f"[{LINE_BREAKS}]", text))}
    assert not held.all["open"] and not held.all["early"] and not held.all["pieces"]


def test_calls_for_state_do_not_grow_with_chunks():
    """A call goes to the JVM and back: a few a bucket and batch, however many pipes and early chunks; a few a large pipe."""
    rng, few = random.Random(3), []
    for n in (50, 500):
        texts, held = {i: "some words\n" * 100 for i in range(n)}, Held()
        rows, processor = cut_up(rng, texts, 100, 200), pipes.Reassembler("bigint")
        processor.init(held)
        assert len(taken(processor, [rows[::2], rows[1::2]])) == 101 * n
        few.append(held.calls)
    assert max(few) <= 8
    rows, held = cut_up(rng, {1: "x" * 1_000_000}, 400, 600), Held()
    processor = pipes.Reassembler("bigint")
    processor.init(held)
    assert taken(processor, [rows[::2], rows[1::2]]) == {(1, 0): "x" * 1_000_000} and held.calls < 100


def test_large_pipes_through_stores(spark, tmp_path):
    """Entries of their own in Spark's state, names of pipes as texts, over restarts."""
    rng = random.Random(11)
    texts = {f"p{i}": "".join(rng.choice(["a", "日", "\n"] if i else ["a"]) for _ in range(120)) for i in range(5)}
    rows = [(r.pipe, r.at, bytearray(r.chunk)) for r in cut_up(rng, texts, 1, 6)]
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    for part in range(3):
        spark.createDataFrame(rows[part::3], pipes.CHUNK.format(pipe="string")).coalesce(1).write.mode("append").parquet(source)
        with disk_state(spark):
            stream = pipes.lines(pipes.read_chunks(spark, source, pipe="string"), buckets=2, held=10, block=32)
            stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.pipe, r.line_no, r.line) for r in spark.read.parquet(out).collect())
    assert got == sorted((p, i, x) for p, text in texts.items() for i, x in enumerate(text.split("\n")))


def test_chunks_of_no_character_and_gaps(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("x", 0, bytearray(b"a\xffb\n\xe6")), ("x", 5, bytearray()), ("gap", 3, bytearray(b"b\n")), ("gap", 0, bytearray(b"a"))]
    spark.createDataFrame(rows, pipes.CHUNK.format(pipe="string")).write.parquet(source)
    with disk_state(spark):
        stream = pipes.lines(pipes.read_chunks(spark, source, pipe="string"))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted((r.pipe, r.line_no, r.line) for r in spark.read.parquet(out).collect()) == [("x", 0, "a�b"), ("x", 1, "�")]


def test_cutting_keeps_every_byte(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.encode("text", "UTF-8").alias("data"))
    for around in (1, 7, 512):
        rows = pipes.chunked(docs.where("length(data) < 5000"), "doc_id", F.col("data"), around)
        whole = rows.groupBy("pipe").agg(F.sum(F.octet_length("chunk")).alias("n"), F.max("at").alias("end"), F.count_if(F.octet_length("chunk") == 0).alias("ends"), F.array_sort(F.collect_list(F.struct("at", "chunk"))).alias("c"))
        joined = docs.join(whole, F.col("doc_id") == F.col("pipe"))
        assert joined.where("n <> octet_length(data) or end <> n or ends <> 1 or aggregate(c, cast('' as binary), (a, x) -> concat(a, x.chunk)) <> data").count() == 0 < joined.count()


def test_outputs_of_programs(spark):
    code = "import sys; print('a'); sys.stdout.flush(); print('b', file=sys.stderr); sys.stderr.flush(); print('c' * 200000); sys.exit(3)"
    rows = outputs(spark.createDataFrame([(1, [sys.executable, "-c", code]), (2, ["/no/such/program"]), (3, None)], "pipe long, argv array<string>")).collect()
    by = {p: sorted((r.at, bytes(r.chunk), r.code) for r in rows if r.pipe == p) for p in (1, 2, 3)}
    assert b"".join(c for _, c, _ in by[1]) == b"a\nb\n" + b"c" * 200000 + b"\n" and by[1][-1] == (200005, b"", 3)
    assert by[2][0][1].startswith(b"FileNotFoundError") and by[2][-1][2] == by[3][-1][2] == 127


def parts(spark, tmp_path, rows, schema, batches):
    """`rows` in one file a batch, in this order."""
    source = str(tmp_path / f"in-{random.random()}")
    for part in batches:
        spark.createDataFrame([rows[i] for i in part], schema).coalesce(1).write.mode("append").parquet(source)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)


@pytest.mark.parametrize("seed", [1, 2])
def test_last_row_after_any_split(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abcdef") if rng.random() < 0.9 else None, i, f"v{i}") for i in range(40)]
    order = rng.sample(range(40), 40)
    cuts = sorted(rng.sample(range(1, 40), seed))
    batches = [order[a:b] for a, b in zip([0, *cuts], [*cuts, 40], strict=True)]
    stream = parts(spark, tmp_path, rows, "k string, i long, v string", batches)
    out = VersionedTable(spark, str(tmp_path / "out"), "k string, i long, v string, overwritten long")
    latest.upserted(latest.keep_last(stream.where("k is not null"), "k", "i"), out, "k", str(tmp_path / "c"), buckets=3).awaitTermination()
    want = transcript.keep_last(spark.createDataFrame(rows, "k string, i long, v string").where("k is not null"), "k", "i")
    assert sorted(map(tuple, out.read().collect())) == sorted(map(tuple, want.select("k", "i", "v", "overwritten").collect()))
    assert out.versions() == list(range(1, len(batches) + 1))


def test_idle_cells_close(spark, tmp_path):
    """The timer of a key fires once the watermark has passed its latest row by `idle`; a newer row moves it."""
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [("a", 1, at(0)), ("b", 1, at(0)), ("b", 2, at(8)), ("c", 1, at(16)), ("d", 1, at(40)), ("d", 2, at(41))]
    stream = parts(spark, tmp_path, rows, "k string, i long, t timestamp", [[0, 1], [2], [3], [4], [5]]).withWatermark("t", "0 seconds")
    seen = []
    with disk_state(spark):
        changes = latest.keep_last(stream, "k", "i", time="t", idle=10)
        changes.writeStream.outputMode("update").foreachBatch(lambda df, n: seen.extend((r.k, r.i, r.closed) for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(x for x in seen if not x[2]) == [("a", 1, False), ("b", 1, False), ("b", 2, False), ("c", 1, False), ("d", 1, False), ("d", 2, False)]
    assert sorted(x for x in seen if x[2]) == [("a", 1, True), ("b", 2, True), ("c", 1, True)]


def test_selection_in_batches_is_that_of_the_batch(spark, tmp_path):
    rows = [(i, p) for i, p in enumerate(["b", "a", "b", "c", None, "a", "d", "c", "e", "e"], 2)]
    existing = spark.createDataFrame([(1, "a")], "i long, path string")
    stream = parts(spark, tmp_path, rows, "i long, path string", [range(0, 4), range(4, 5), range(5, 10)])
    kept = VersionedTable(spark, str(tmp_path / "kept"), "i long, path string, file_index long")
    kept.append(existing.withColumn("file_index", F.lit(1).cast("long")))
    latest.selected(stream, kept, "path", "i", str(tmp_path / "c"), existing=existing).awaitTermination()
    want = selection.append(existing, spark.createDataFrame([r for r in rows if r[1]], "i long, path string"), "path", "i")
    assert sorted((r.file_index, r.path, r.i) for r in kept.read().collect()) == sorted((r.file_index, r.path, r.i) for r in want.collect())


def test_first_seen_in_a_few_calls_a_bucket():
    """Two calls for state a bucket and batch, however many keys; what was known, or came before, stays out."""
    held, processor = Held(), latest.FirstSeen("i", ["i", "k"])
    processor.init(held)
    digest = lambda k: k.to_bytes(32, "big")
    processor.handleInitialState((0,), {"_digests": digest(7) + digest(8)}, None)
    rows = lambda *pairs: iter([Row(_bucket=0, _digest=bytearray(digest(k)), i=i, k=k) for i, k in pairs])
    got = [sorted(processor.handleInputRows((0,), rows(*pairs), None)) for pairs in ([(i, i % 500) for i in range(1999, -1, -1)], [(5000, 3), (5002, 600), (5001, 600)], [(9, 600)])]
    assert got == [[(i, i) for i in range(500) if i not in (7, 8)], [(5001, 600)], []]
    assert held.calls <= 1 + 3 * 2


def test_a_batch_goes_through_its_state_once(spark, tmp_path, monkeypatch):
    """Indexes and upserts read a batch several times; its keys are asked for once."""
    import uuid

    def counted(kind):
        folder = tmp_path / kind.__name__
        folder.mkdir()

        class Counted(kind):
            def handleInputRows(self, key, rows, timerValues):
                open(f"{folder}/{uuid.uuid4().hex}", "w").close()
                return super().handleInputRows(key, rows, timerValues)

        monkeypatch.setattr(latest, kind.__name__, Counted)
        return folder

    first, last = counted(latest.FirstSeen), counted(latest.LastRow)
    rows = [(i, f"p{i}") for i in range(12)]
    stream = lambda: parts(spark, tmp_path, rows, "i long, path string", [range(12)])
    kept = VersionedTable(spark, str(tmp_path / "kept"), "i long, path string, file_index long")
    latest.selected(stream(), kept, "path", "i", str(tmp_path / "c1")).awaitTermination()
    out = VersionedTable(spark, str(tmp_path / "out"), "path string, i long, overwritten long")
    latest.upserted(latest.keep_last(stream(), "path", "i"), out, "path", str(tmp_path / "c2"), buckets=3).awaitTermination()
    assert kept.read().count() == out.read().count() == len(list(first.iterdir())) == len(list(last.iterdir())) == 12


def test_readers_see_whole_versions(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"), "kind string, message string")
    assert log.read().count() == 0 and log.manifest()["version"] == 0
    many = spark.range(50).select(F.lit("info").alias("kind"), F.col("id").cast("string").alias("message"))
    log.append(many)
    seen, done = set(), threading.Event()

    def read():
        while not done.is_set():
            seen.add(log.read().count())

    reader = threading.Thread(target=read)
    reader.start()
    for _ in range(3):
        log.reset(ready(spark))
        log.reset(many)
    done.set()
    reader.join()
    assert seen <= {1, 50} and seen
    assert log.manifest(1)["rows"] == 50 and log.read(2).first().message == "Ready."


def test_writers_that_meet_and_run_twice(spark, tmp_path):
    log = VersionedTable(spark, str(tmp_path / "log"), "kind string, message string")
    one = spark.createDataFrame([("info", "x")], "kind string, message string")
    threads = [threading.Thread(target=log.append, args=(one,)) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.read().count() == 4 and log.versions() == [1, 2, 3, 4]
    for batch in (0, 0, 1, 0):
        log.append(one, writer="w", batch=batch)
    assert log.read().count() == 6
    assert log.append(one.limit(0)) == 6  # nothing to say
    log.compact()
    assert log.read().count() == 6 and len(log.manifest()["folders"]) == 1
    log.vacuum(keep=1)
    assert log.versions() == [7] and log.read().count() == 6 and len(log.store.names(f"{log.path}/data")) == 1


def test_upsert_rewrites_changed_buckets_only(spark, tmp_path):
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "k string, v long")
    table = VersionedTable(spark, str(tmp_path / "t"), "k string, v long")
    table.upsert(rows(*((f"k{i}", i) for i in range(40))), "k", buckets=8)
    before = {f["bucket"]: f["path"] for f in table.manifest()["folders"]}
    table.upsert(rows(("k3", 300), ("new", 1)), "k", buckets=8)
    after = {f["bucket"]: f["path"] for f in table.manifest()["folders"]}
    assert sum(after[b] != before.get(b) for b in after) <= 2 and table.manifest()["rows"] == 41
    assert {r.k: r.v for r in table.read().collect()} == {f"k{i}": i for i in range(40)} | {"k3": 300, "new": 1}
    with pytest.raises(ValueError, match="8 buckets"):
        table.upsert(rows(("k3", 1)), "k", buckets=4)


def test_a_queue_is_drained_on_a_timer(spark, tmp_path):
    """Events that arrive while the stream polls: log rows in order, the last status, the end of the run; then nothing more."""
    import time

    from tapeline.streaming import queue

    source = tmp_path / "queue"
    schema = queue.EVENT.format(run="string")
    log, state = VersionedTable(spark, str(tmp_path / "log"), queue.LOG.format(run="string")), VersionedTable(spark, str(tmp_path / "state"), queue.STATE.format(run="string"))
    spark.createDataFrame([], schema).write.parquet(str(source))
    running = queue.drained(spark.readStream.schema(schema).parquet(str(source)), log, state, str(tmp_path / "c"), buckets=2)
    parts = [
        [("r", 1, "log", "info|Loading a|b"), ("r", 2, "status", "Loading|0/2"), ("other", 3, "log", "error|x")],
        [("r", 5, "status", "Working|1/2"), ("r", 4, "log", "success|Saved"), ("r", 6, "log", None), ("r", 7, "log", "no bar")],
        [("r", 8, "done", None)],
    ]
    try:
        for n, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
            until = time.time() + 60
            while time.time() < until and max((r.seq for r in state.read().collect()), default=0) < max(p[1] for p in part):
                time.sleep(0.3)
            rows = {r.run: (r.status, r.progress, r.done) for r in state.read().collect()}
            assert rows["r"] == [("Loading", "0/2", False), ("Working", "1/2", False), ("Working", "1/2", True)][n]
    finally:
        running.stop()
    assert rows["other"] == (None, None, False)
    assert [(r.seq, r.level, r.message) for r in log.read().where("run = 'r'").orderBy("seq").collect()] == [(1, "info", "Loading a|b"), (4, "success", "Saved")]
