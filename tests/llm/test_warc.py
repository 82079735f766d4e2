import base64
import gzip
import hashlib
import os
import zlib

from tapeline.llm import warc as x

SCHEMA = "page_id long, url string, html string"


def brute(rows, least=0):
    leaders = {}
    for i, _, h in rows:
        leaders.setdefault(h or "", []).append(-1 if i is None else i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        top = max(leaders[h or ""])
        again = len(data) >= least and (-1 if i is None else i) != top
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


ROWS = [(1, "http://a/x y", "<p>é"), (2, "http://a/", "<p>é"), (3, None, None), (4, "b\r\nWARC-Type: x", ""), (5, "http://c", "WARC/1.1\r\n\r\nx\r\n\r\n"), (6, "http://c", "WARC/1.1\r\n\r\nx\r\n\r\n"), (None, "http://d", "z"), (7, "http://d", "y" * 300_000)]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS place", "2 AS sha", "3 AS leader").repartition(3)
    for least in (0, 4):
        assert sorted(map(tuple, x.round_trip(pages, revisit_bytes=least).collect()), key=str) == brute(ROWS, least)


def test_fixture(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, x.round_trip(pages).collect()), key=str) == brute(rows)


def test_captures_are_whole(spark, tmp_path):
    path = f"file://{tmp_path}/warc"
    x.write(spark.createDataFrame(ROWS[:3], SCHEMA), path)
    rows = x.read(spark, path)
    assert rows.count() == 9
    captures = x.assemble(rows).collect()
    assert len(captures) == 3
    for c in captures:
        assert c.request.record_id != c.response.record_id and c.metadata.fields is not None
        assert bytes(c.request.block).startswith(b"GET ") and bytes(c.response.block).startswith(b"HTTP/1.1 200")


def test_repeated_rows_have_one_response(spark):
    got = x.round_trip(spark.createDataFrame([(1, "u", "a")] * 3, SCHEMA)).collect()
    assert sorted(r.record_type for r in got) == ["response", "revisit", "revisit"]


def test_empty(spark):
    assert x.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archives(folder):
    return [open(f"{d}/{f}", "rb").read() for d, _, fs in os.walk(folder) for f in fs if f.startswith("part-")]


def test_files_are_cut_by_bytes_with_a_member_a_record(spark, tmp_path):
    """300 pages of 1 MB that don't compress, 16 MB a file; each record is a gzip member, and whole files are plain gzip."""
    pages = spark.range(0, 300, 1, 30).selectExpr("id AS page_id", "'http://h/' || id AS url", "array_join(transform(sequence(1, 16384), i -> sha2(concat(id, ':', i), 256)), '') AS html")
    x.write(pages, f"file://{tmp_path}/warc")
    files = archives(tmp_path / "warc")
    assert len(files) >= 10 and all(len(f) <= 16 << 20 for f in files)
    first, members = files[0], 0
    while first:
        unpack = zlib.decompressobj(31)
        record = unpack.decompress(first)
        assert unpack.eof and record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
        first, members = unpack.unused_data, members + 1
    assert members == gzip.decompress(files[0]).count(b"WARC-Type: ")
    rows = x.read(spark, f"file://{tmp_path}/warc", with_blocks=False)
    assert rows.count() == 900 and rows.where("payload_bytes = 1048576").count() == 300


def test_members_end_with_a_zero_byte(spark, tmp_path):
    for size in (0, 1, 255, 70_000, (1 << 24) - 1, 1 << 24, (1 << 24) + 5):
        data = x.member(b"a" * size)
        assert data.endswith(b"\0") and gzip.decompress(data) == b"a" * size
    big = spark.createDataFrame([(1, "u", "b" * ((1 << 24) + 7)), (2, "u", "c")], SCHEMA)
    assert sorted((r.page_id, r.payload_bytes) for r in x.round_trip(big).collect()) == [(1, (1 << 24) + 7), (2, 1)]
