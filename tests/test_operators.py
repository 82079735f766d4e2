import json
import os

import pytest
from pyspark.sql import functions as F

from tapeline.operators import logs, selection, transcript
from tapeline.operators.ordering import with_index
from tapeline.operators.recognise import Stub, first_device, observed, recognise
from tapeline.schemas import Settings, first_set
from tapeline.sinks.markdown import discard, write_markdown
from tapeline.sources import media
from tapeline.sources.results import parse_results
from tapeline.streaming import logs as stream_logs

def created():
    return F.lit("2024-01-02 03:04:05").cast("timestamp")


def results(spark, *documents):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(documents)], "file_index long, json string")
    return parse_results(rows)


def test_results_with_gaps(spark):
    got = results(spark, {"text": " x "}, {"segments": [{"text": " a "}, {"start": 1.5, "end": 2.0, "text": None}, {"start": 2.0, "end": 3.0, "text": "b"}]}, {})
    rows = transcript.prepare(transcript.explode_results(got)).orderBy("segment_index").collect()
    assert [(r.file_index, r.segment_index, r.block) for r in rows] == [(1, 0, "00:00:00:00 - 00:00:00:00\na"), (1, 2, "00:00:02:00 - 00:00:03:00\nb")]


@pytest.mark.parametrize("timed,full,wanted,body", [("t", "f", True, "t"), (None, " f ", True, "f"), ("t", "f", False, "f"), (None, None, True, "")])
def test_body_choice(spark, timed, full, wanted, body):
    row = spark.createDataFrame([(timed, full)], "timed string, full string")
    assert row.select(transcript.chosen_body(F.col("timed"), F.col("full"), wanted)).first()[0] == body


def test_document_text_and_collisions(spark):
    files = spark.createDataFrame([(1, "/d/a.mp3", "x", "y"), (2, '/d/a.mov', None, " z "), (3, '/d/q".wav', "t", None)], "file_index long, path string, timed string, full_text string")
    got = {r.output_path: r for r in transcript.render(files, Settings(), created()).collect()}
    assert set(got) == {"/d/a.md", '/d/q".md'} and got["/d/a.md"].file_index == 2 and got["/d/a.md"].overwritten == 1
    assert got["/d/a.md"].content == (
        '---\ncreated: "2024-01-02 03:04"\nmodel: "large"\ndevice: "cpu"\nsource_file: "a.mov"\nfps_timecode: 25\ntimecodes: true\n---\n\n# Transkript: a\n\n---\n\nz\n'
    )
    legacy = transcript.render(files, Settings(timecodes_key=False, heading="Transcript", output_folder="/o"), created()).where("file_index = 3").first()
    assert legacy.output_path == '/o/q".md' and "timecodes" not in legacy.content and '# Transcript: q"' in legacy.content and 'source_file: "q\\".wav"' in legacy.content


def test_arguments(spark):
    row = spark.range(1).select(transcript.arguments(Settings(output_folder="/o"), F.array(F.lit("a"), F.lit("b"))).alias("x")).first()
    assert row.x == ["--language", "de", "--model", "large", "--buffer", "2", "--timecodes", "--output-dir", "/o", "--file", "a", "--file", "b"]


def test_selection(spark):
    existing = spark.createDataFrame([(1, "a")], "i long, path string")
    chosen = spark.createDataFrame([(2, "b"), (3, "a"), (4, "b"), (5, "c")], "i long, path string")
    got = selection.append(existing, chosen, "path", "i").orderBy("file_index").collect()
    assert [(r.path, r.i, r.file_index) for r in got] == [("a", 1, 1), ("b", 2, 2), ("c", 5, 3)]
    assert selection.additions(existing, chosen, "path", "i", within_batch=False).count() == 3
    assert selection.cleared(existing).count() == 0
    assert selection.count_text(selection.cleared(existing)).first().label == "No files selected"


def test_index_over_partitions(spark):
    rows = with_index(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")), "k").collect()
    assert all(r.file_index == r.k + 1 for r in rows) and len(rows) == 1000


def test_first_candidate(spark):
    rows = spark.createDataFrame([("g", 1, "a", False), ("g", 2, "b", True), ("g", 3, "c", False), ("h", 1, "d", False)], "g string, p int, v string, ok boolean")
    got = {r.g: (r.chosen, r.rejected) for r in selection.first_candidate(rows, "g", "p", "v", F.col("ok")).collect()}
    assert got == {"g": ("b", "a"), "h": (None, "d")}


def test_recognise(spark):
    class Failing(Stub):
        def __call__(self, path, language):
            if "bad" in path:
                raise OSError("unreadable")
            return Stub.__call__(self, path, language)

    files = media.from_paths(spark, ["/d/a.mp3", "/d/bad.mp3"])
    run = lambda: recognise(files, Settings(language="en"), lambda device: Failing(), model="failing")
    got = {r.name: r for r in run().collect()}
    assert got["bad.mp3"].result is None and got["bad.mp3"].error.startswith("OSError: unreadable\nTraceback")
    assert got["a.mp3"].error is None and got["a.mp3"].result.segments[0].text == " en segment 0 of /d/a.mp3 "
    assert got["a.mp3"].device == "cpu" and got["a.mp3"].created is not None
    assert run().where("error is null").first().result == got["a.mp3"].result
    rows, seen = observed(run())
    rows.collect()
    assert seen.get["files"] == 2 and seen.get["failed"] == 1


def test_devices(spark):
    def load(device):
        if device != "cpu":
            raise NotImplementedError(device)
        return Stub()

    assert first_device(load, ["gpu", "cpu"])[1] == "cpu"
    with pytest.raises(NotImplementedError):
        first_device(load, ["gpu"])
    files = media.from_paths(spark, ["/d/a.mp3"])
    assert recognise(files, Settings(), load, ["tpu", "cpu"], model="any").first().device == "cpu"
    assert "NotImplementedError" in recognise(files, Settings(), load, ["tpu"], model="any").first().error


def test_a_worker_loads_its_model_once(spark, tmp_path):
    """Over several tasks and jobs: as many loads as workers that answered; the next run finds the models loaded."""
    class Counted(Stub):
        def __init__(self):
            (tmp_path / f"{os.getpid()}-{os.urandom(4).hex()}").touch()

        def __call__(self, path, language):
            return {"text": str(os.getpid()), "segments": []}

    files = media.from_paths(spark, [f"/d/{i}.mp3" for i in range(64)]).repartition(16)
    workers = set()
    for _ in range(3):
        workers |= {r.result.text for r in recognise(files, Settings(), lambda device: Counted(), model="counted").collect()}
    loads = [f.name.split("-")[0] for f in tmp_path.iterdir()]
    assert set(loads) == workers and len(loads) == len(workers) < 48


def test_leased_devices(monkeypatch):
    from pyspark.resource import ResourceInformation

    from tapeline.operators import recognise as module

    assert module.leased(["gpu", "cpu"]) == ["cpu"]
    task = type("Task", (), {"resources": lambda self: {"gpu": ResourceInformation("gpu", ["2", "5"])}})()
    monkeypatch.setattr(module.TaskContext, "get", classmethod(lambda cls: task))
    assert module.leased(["gpu", "cpu"]) == ["gpu:2", "gpu:5", "cpu"]


def test_resources_of_a_run(spark, tmp_path):
    from tapeline.session import resource

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "given.txt").write_text("x")
    (tmp_path / "own.txt").write_text("y")
    spark.sparkContext.addFile(str(tmp_path / "a" / "given.txt"))
    at = str(tmp_path)

    def look(batches):
        for b in batches:
            b["found"] = [(lambda p: None if p is None else open(p).read())(resource(n, at)) for n in b["name"]]
            yield b

    rows = spark.createDataFrame([("given.txt",), ("own.txt",), ("none.txt",)], "name string").mapInPandas(look, "name string, found string").collect()
    assert {r.name: r.found for r in rows} == {"given.txt": "x", "own.txt": "y", "none.txt": None}


def test_media_by_their_first_bytes(spark, tmp_path):
    wav, mkv = b"RIFF\0\0\0\0WAVEfmt ", bytes.fromhex("1A45DFA3")
    for name, data in {"a.txt": wav, "b.mp3": b"no sound", "c": mkv, "d.wav": b"", "e": bytes.fromhex("1A45DFA3A342868101428284") + b"webm"}.items():
        (tmp_path / name).write_bytes(data + b"x" * (200 if data else 0))
    want = {"a.txt": "wav", "c": "mkv", "e": "webm"}
    assert {r.name: r.kind for r in media.by_content(media.list_media(spark, str(tmp_path), every_file=True)).collect()} == want
    plain = media.from_paths(spark, [str(tmp_path / n) for n in ("a.txt", "b.mp3", "gone")])
    assert {r.name: r.kind for r in media.by_content(plain).collect()} == {"a.txt": "wav"}
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.kinds.link./w", f"file://{tmp_path}")
    assert {r.name: r.kind for r in media.by_content(media.list_media(spark, "viewfs://kinds/w", every_file=True)).collect()} == want


def test_preconditions():
    Settings(output_folder="/o").check(1, folder_needed=True)
    for bad in ({"files": 0}, {"files": 1, "folder_needed": True}, {"files": 1, "running": True}):
        with pytest.raises(ValueError):
            Settings().check(**bad)
    assert first_set(None, "", "b", "c") == "b" and first_set(None) is None


def test_paths_become_absolute(spark):
    got = media.from_paths(spark, ["a.mp3", "/x/../b.mp3", "./c//d.mp3"], base="/w").orderBy("file_index").collect()
    assert [r.path for r in got] == ["/w/a.mp3", "/b.mp3", "/w/c/d.mp3"]


def test_progress_over_all_rows_and_ids(spark):
    rows = spark.createDataFrame([(3,), (1,), (2,)], "i long")
    got = selection.progress(rows, [], "i").orderBy("i").collect()
    assert [(r.label, r.waits) for r in got] == [("1/3", True), ("2/3", True), ("3/3", False)]
    assert len({r.id for r in selection.identified(rows).collect()}) == 3


def test_documents_stay_below_their_folder(spark, tmp_path):
    with pytest.raises(Exception, match="outside"):
        write_markdown(spark.createDataFrame([("../../x.md", "x")], "output_path string, content string"), str(tmp_path / "root"))


def test_media_list(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("b.MP3", "a.wav", "c.txt", "sub/d.mov"):
        (tmp_path / name).write_bytes(b"x")
    got = media.list_media(spark, str(tmp_path)).orderBy("file_index").collect()
    assert [r.name for r in got] == ["a.wav", "b.MP3", "d.mov"] and [r.file_index for r in got] == [1, 2, 3]
    assert media.list_media(spark, str(tmp_path), recursive=False, every_file=True).count() == 3


def test_markdown_files(spark, tmp_path):
    docs = spark.createDataFrame([("/x/a.md", "é\n"), ("/x/y/b.md", "b\n")], "output_path string, content string")
    write_markdown(docs, str(tmp_path))
    write_markdown(docs.limit(1).withColumn("content", F.lit("new\n")), str(tmp_path))
    assert (tmp_path / "x/a.md").read_text(encoding="utf-8") == "new\n" and (tmp_path / "x/y/b.md").read_text() == "b\n"
    assert not [f for _, _, fs in os.walk(tmp_path) for f in fs if f.endswith(".part")]
    discard(docs)


def test_stream_is_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    texts = ["Loading model 'x'\n10%|#\n\n", "50%|## [0<00:09, 1it/s]\nSaved: /a.md\n", "Error: no\n  \n99%|\n"]
    for i, t in enumerate(texts):
        (source / f"{i}.txt").write_text(t)
    stream = stream_logs.transform(stream_logs.read_lines(spark, str(source), files_per_batch=1)).withColumn("run", F.lit(1)).withColumn("seq", F.substring("file", 1, 1).cast("long"))
    log, progress = str(tmp_path / "log"), str(tmp_path / "progress")
    stream_logs.write_both(stream, log, progress, str(tmp_path / "checkpoint"), "run", "seq").awaitTermination()
    batch = logs.routed(logs.split_lines(spark.createDataFrame([(t,) for t in texts], "value string"), "value"))
    want = sorted((r.kind, r.message) for r in logs.log_rows(batch).collect())
    assert sorted((r.kind, r.message) for r in spark.read.parquet(log).collect()) == want
    assert logs.latest(spark.read.parquet(progress), "run", "seq").first().message == "Transcribing... 99%"
    stream_logs.reset_log(spark, log)
    assert spark.read.parquet(log).first().message == "Ready."
