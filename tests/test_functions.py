import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeline.functions import loglines, paths, text, timecode
from tapeline.schemas import Settings


def evaluate(spark, column, values, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("x"))).collect()]


def formula(seconds, fps=25):
    f = round(max(0.0, seconds) * fps) if not math.isnan(seconds) else 0
    s, ff = divmod(f, fps)
    m, ss = divmod(s, 60)
    h, mm = divmod(m, 60)
    return f"{h:02d}:{mm:02d}:{ss:02d}:{ff:02d}"


CASES = {
    0.0: "00:00:00:00", 0.02: "00:00:00:00", 0.06: "00:00:00:02", 0.1: "00:00:00:02", 0.58: "00:00:00:14", 0.98: "00:00:00:24", 0.99: "00:00:01:00",
    59.99: "00:01:00:00", 3599.99: "01:00:00:00", 86400.0: "24:00:00:00", 360000.0: "100:00:00:00", -3.0: "00:00:00:00", math.nan: "00:00:00:00",
}


def test_timecode_cases(spark):
    assert evaluate(spark, timecode.timecode, list(CASES), "double") == list(CASES.values())
    assert evaluate(spark, timecode.timecode, [None], "double") == ["00:00:00:00"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-10, 1e6), min_size=50, max_size=200))
def test_timecode_formula_and_inverse(spark, values):
    assert evaluate(spark, timecode.timecode, values, "double") == [formula(v) for v in values]
    assert all(evaluate(spark, lambda x: timecode.to_frames(timecode.timecode(x)) == timecode.frames(x), values, "double"))


def test_yaml_quote(spark):
    values = ["a", 'a"b', "a\\b", 'a\\"b', "", "a\nb", None]
    assert evaluate(spark, text.yaml_quote, values) == ['"a"', '"a\\"b"', '"a\\\\b"', '"a\\\\\\"b"', '""', '"a\nb"', None]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet='ab"\\\n', max_size=12), min_size=20, max_size=60))
def test_yaml_quote_inverts(spark, values):
    for value, quoted in zip(values, evaluate(spark, text.yaml_quote, values), strict=True):
        inner, out, i = quoted[1:-1], [], 0
        while i < len(inner):
            i += inner[i] == "\\"
            out.append(inner[i])
            i += 1
        assert "".join(out) == value


def test_strip(spark):
    values = ["\t x \n", "\xa0x　", "\x1cx", "​x", "", " ", "x y"]
    assert evaluate(spark, text.strip, values) == [v.strip() for v in values]
    assert len(set(text.STRIPPED)) == 29 and all(not c.strip() for c in text.STRIPPED)


def test_defaults_and_labels(spark):
    assert evaluate(spark, lambda x: text.default_text(x, "large"), [None, "", " \t", " m "]) == ["large", "large", "large", "m"]
    assert evaluate(spark, text.count_label, [0, 1, 2], "int") == ["No files selected", "1 file selected", "2 files selected"]
    assert evaluate(spark, lambda x: text.clamp(x, 0, 60), [-1, 5, 99], "int") == [0, 5, 60]


def test_lines(spark):
    assert evaluate(spark, text.lines, ["a\rb\n\nc d\x85e", ""]) == [["a", "b", "", "c", "d", "e"], [""]]


@pytest.mark.parametrize(
    "path,name,stem,suffix,folder",
    [
        ("/d/a.mp3", "a.mp3", "a", ".mp3", "/d"), ("/d/.mp3", ".mp3", ".mp3", "", "/d"), ("/d/foo.", "foo.", "foo.", "", "/d"), ("/d/..mp3", "..mp3", ".", ".mp3", "/d"),
        ("/a", "a", "a", "", "/"), ("a.b.c", "a.b.c", "a.b", ".c", "."), ("/d/e/", "e", "e", "", "/d"),
    ],
)
def test_paths(spark, path, name, stem, suffix, folder):
    got = [evaluate(spark, f, [path])[0] for f in (paths.name, paths.stem, paths.suffix, paths.folder)]
    assert got == [name, stem, suffix, folder]


def test_targets(spark):
    assert evaluate(spark, paths.target, ["/d/a.mp3", "/a.mp3"]) == ["/d/a.md", "/a.md"]
    assert evaluate(spark, lambda x: paths.target(x, F.lit("/out/")), ["/d/a.mp3"]) == ["/out/a.md"]
    assert evaluate(spark, paths.is_media, ["a.MOV", "a.mp3", "a.txt", "mp3"]) == [True, True, False, False]


LINES = {
    " 42%| 10/20 [00:03<00:04, 9frames/s]": ("progress", None, "Transcribing... 42%, ETA 00:04"),
    "100%|####": ("progress", None, "Transcribing... 100%"),
    "9.0it/s]": ("progress", None, "Transcribing..."),
    "1234%|": ("progress", None, "Transcribing..."),
    "Model loaded. Using device 'cpu'.": ("log", "success", "Model loaded. Using device 'cpu'."),
    "Loading model 'x'": ("log", "info", "Loading model 'x'"),
    "Saved: /x/error_log.md": ("log", "error", "Saved: /x/error_log.md"),
    "Saved: /x/a.md": ("log", "success", "Saved: /x/a.md"),
}


def test_log_routing(spark):
    from tapeline.operators.logs import routed, split_lines

    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*LINES, "  ", ""])], "i int, text string")
    got = {r.i: (r.route, r.kind, r.message) for r in routed(split_lines(rows, "text")).collect()}
    assert got == dict(enumerate(LINES.values()))


def test_decoding(spark):
    level, message = (evaluate(spark, lambda x, k=k: loglines.split_once(x)[k], ["info|a|b", "x"]) for k in (0, 1))
    assert level == ["info", "x"] and message == ["a|b", None]
    assert evaluate(spark, loglines.decoded, [b"a\xc3\xa9", b"\xc3"], "binary") == ["aé", None]
    assert evaluate(spark, loglines.prefix, ["info", "success", "error", "?"]) == ["INFO", "OK", "ERROR", "INFO"]
    assert evaluate(spark, lambda x: loglines.error_rows(x, F.lit("2"), F.lit("")), ["exit", "other"]) == [["The run ended with code 2"], ["Error: 2"]]
    assert evaluate(spark, lambda x: loglines.error_rows(x, F.lit("2"), F.lit("trace")), ["other"]) == [["Error: 2", "trace"]]


def test_settings():
    assert Settings(model_name="  ", buffer_seconds=99).model_name == "large" and Settings(buffer_seconds=-1).buffer_seconds == 0
    with pytest.raises(ValueError, match="language"):
        Settings(language="fr")
