"""WARC archives of captured pages: writing with deduplicated payloads, reading, and transaction assembly.

Every capture becomes three records of one archive: a request, a response (or revisit) and a metadata record; request and
metadata name the response by WARC-Concurrent-To. Of captures with equal payloads of at least `revisit_bytes` bytes the
one with the largest page_id (of equal ones, the later row) is the response; the others are revisit records without
payload that refer to it. Smaller payloads are all responses.

Each record is compressed by itself, as a gzip member, and Spark's text writer makes the files, in any store: it writes a value's
bytes as they are and a separator after them, so the separator is the member's own last byte. That byte is the highest of the
record's length, 0 for records under 16 MB; longer ones are followed by an empty member, which ends with 0 too. A task begins
another file once one has `file_bytes`, whatever the number and length of the records. Reading takes files whole (`binaryFile`),
unpacks them as a stream, and walks the records by Content-Length, so payloads may hold anything: a task holds a compressed file
of bounded bytes (or of one record that is longer), one record and about 8 MB of output. Assembly joins requests,
responses and metadata on the response's record id and emits one nested row per capture; a revisit's payload figures come
from the response that it refers to. Nothing is grouped by payload but the digests, with partial aggregates; the join back
to a payload that a third of all captures share is split by adaptive execution.

Null html: empty payload. Null url: empty target. Null page_id: the smallest, and null again after reading. Line ends,
tabs and spaces of a url are percent-encoded, other control characters left out. Repeated rows: the later is the response. Empty table: no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeline.llm.exact_dedup import located
from tapeline.session import materialise, work_path

#: Fixed values of the WARC 1.1 and HTTP formats.
END, PROFILE = "\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
GZIP = b"\x1f\x8b"
DATE = "1970-01-01T00:00:00Z"
#: Compressed bytes of one archive file at most: a reader holds one compressed file.
FILE_BYTES = 1 << 24


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four symbols."""
    hexed = F.sha1(data)
    symbols = []
    for i in range(8):
        value = F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 10).cast("int")
        symbols += [F.substring(F.lit(BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*symbols)


def _record_id(place: Column, kind: str) -> Column:
    h = F.md5(F.concat_ws(":", place["file"].cast("string"), place["row"].cast("string"), F.lit(kind)))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record up to its closing line ends; headers with a null value are left out."""
    lines = [F.concat(F.lit(f"{name}: "), value, F.lit(END)) for name, value in headers]
    head = F.concat(F.lit("WARC/1.1" + END + "WARC-Type: "), kind, F.lit(END), *(F.coalesce(x, F.lit("")) for x in lines))
    return F.concat(head, F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END + END), block)


def records(pages: DataFrame, revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """`value`: the text of each record, three for each row of `pages` (page_id, url, html)."""
    pages, place = located(pages)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    for code in (9, 10, 13, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(url, r"[\x00-\x1f\x7f]", "").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), place.alias("place")
    ).withColumn("sha", F.sha2("html", 256)).withColumn("size", F.octet_length("html"))
    keys = rows.where(F.col("size") >= revisit_bytes).select("sha", "page_id", "place")
    leaders = keys.groupBy(F.col("sha").alias("l_sha")).agg(F.max(F.struct("page_id", "place")).alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(leaders, (rows.sha == F.col("l_sha")) & (F.col("size") >= revisit_bytes), "left")
    again = F.col("leader").isNotNull() & (F.col("place") != F.col("leader.place"))
    digest = F.concat(F.lit("sha1:"), base32_sha1(F.col("html")))
    own = _record_id(F.col("place"), "response")
    parts = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 1), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", 2)
    http = F.concat(F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "), F.col("size").cast("string"), F.lit(END + END))
    common = [("WARC-Date", F.lit(date)), ("WARC-Target-URI", F.col("url"))]
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        [
            ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", digest), ("WARC-Profile", F.when(again, PROFILE)),
            ("WARC-Refers-To", F.when(again, _record_id(F.col("leader.place"), "response"))), ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.concat(http, F.when(again, "").otherwise(F.col("html"))),
    )
    request = _record(
        F.lit("request"),
        [("WARC-Record-ID", _record_id(F.col("place"), "request")), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http; msgtype=request"))],
        F.concat(F.lit("GET "), F.when(parts[1] == "", "/").otherwise(parts[1]), F.lit(" HTTP/1.1" + END + "Host: "), parts[0], F.lit(END + END)),
    )
    metadata = _record(
        F.lit("metadata"),
        [("WARC-Record-ID", _record_id(F.col("place"), "metadata")), *common, ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))],
        F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(END)), F.lit("")),
    )
    return joined.select(F.explode(F.array(request, response, metadata)).alias("value"))


_EMPTY = gzip.compress(b"", mtime=0)


def member(record: bytes) -> bytes:
    """`record` as gzip that ends with a zero byte."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = packer.compress(record) + packer.flush()
    return data if data.endswith(b"\0") else data + _EMPTY


def _packed(file_bytes: int):
    """Each record as a member without its last byte, and the number of the task's file that it goes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size, files, members, held = 0, 0, [], [], 0
        for batch in batches:
            for value in batch.column("value"):
                data = member(value.as_buffer().to_pybytes() + (END + END).encode())
                if size and size + len(data) > file_bytes:
                    file, size = file + 1, 0
                size += len(data)
                held += len(data)
                files.append(file)
                members.append(data[:-1])
                if held > 1 << 23:
                    yield pa.record_batch([pa.array(files, pa.int32()), pa.array(members, pa.binary())], ["file", "value"])
                    files, members, held = [], [], 0
        if files:
            yield pa.record_batch([pa.array(files, pa.int32()), pa.array(members, pa.binary())], ["file", "value"])

    return run


#: Bounds of a write: Arrow batches by bytes, and files of a task that are open at once (so that records aren't sorted by file).
_WRITING = {"spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 25), "spark.sql.maxConcurrentOutputFileWriters": "64"}


def write(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES, **options) -> None:
    """Write archives of at most `file_bytes` (or one longer record) below `path`, a gzip member a record."""
    spark = pages.sparkSession
    rows = records(pages, **options).mapInArrow(_packed(file_bytes), "file int, value binary")
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        rows.select("file", F.col("value").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\0").text(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def parse(archive: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of an archive, read one record at a time."""
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record, but {line[:40]!r}")
        headers = {}
        while (line := archive.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8").removesuffix(END).partition(": ")
            headers[name.lower()] = value
        block = archive.read(int(headers["content-length"]))
        archive.read(4)
        yield headers, block


def _open(data: bytes) -> BinaryIO:
    """The archive in `data`; one gzip stream or one per record."""
    raw = io.BytesIO(data)
    return io.BufferedReader(gzip.GzipFile(fileobj=raw)) if data[:2] == GZIP else raw


RECORD = "kind string, record_id string, concurrent_to string, refers_to string, url string, block binary, fields map<string,string>, payload_bytes long, payload_digest string"


def _records(with_blocks: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 5 + [pa.binary(), pa.map_(pa.string(), pa.string()), pa.int64(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for headers, block in parse(_open(content.as_py())):
                    kind, payload, fields = headers["warc-type"], None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                    elif kind == "metadata":
                        fields = [tuple(x.split(": ", 1)) for x in block.decode("utf-8").split(END) if ": " in x]
                    held.append((
                        kind, headers["warc-record-id"], headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"),
                        block if with_blocks else None, fields, None if payload is None else len(payload),
                        None if payload is None else base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    ))
                    size += len(block) if with_blocks else 200
                    if size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    return run


def read(spark: SparkSession, path: str, with_blocks: bool = True) -> DataFrame:
    """One row per record of the archives below `path`; payload figures for responses."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("content").mapInArrow(_records(with_blocks), RECORD)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: request, response (or revisit), metadata, and the response that a revisit refers to."""
    own = ["record_id", "url", "block", "payload_bytes", "payload_digest"]
    response = rows.where("kind in ('response', 'revisit')").select(F.col("record_id").alias("id"), F.struct("kind", "refers_to", *own).alias("response"))
    request = rows.where("kind = 'request'").select(F.col("concurrent_to").alias("q_id"), F.struct("record_id", "url", "block").alias("request"))
    metadata = rows.where("kind = 'metadata'").select(F.col("concurrent_to").alias("m_id"), F.struct("record_id", "fields").alias("metadata"))
    captures = response.join(request, response.id == F.col("q_id"), "left").join(metadata, response.id == F.col("m_id"), "left")
    target = captures.where("response.kind = 'response'").select(
        F.col("id").alias("t_id"),
        F.struct(F.col("metadata.fields").alias("fields"), F.col("response.payload_bytes").alias("payload_bytes"), F.col("response.payload_digest").alias("payload_digest")).alias("original"),
    )
    return captures.join(target, F.col("response.refers_to") == F.col("t_id"), "left").select("request", "response", "metadata", "original")


def round_trip(pages: DataFrame, revisit_bytes: int = 0) -> DataFrame:
    """Write the archives of `pages`, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write(pages, path, revisit_bytes=revisit_bytes)
    # Without blocks a record is a few short strings: they are written, so that the three uses don't read the archives again.
    captures = assemble(materialise(read(spark, path, with_blocks=False), "warc-records"))
    number = lambda fields: F.col(fields)["page-id"].cast("long")
    return captures.select(
        number("metadata.fields").alias("page_id"),
        F.coalesce("response.payload_bytes", "original.payload_bytes").alias("payload_bytes"),
        F.coalesce("response.payload_digest", "original.payload_digest").alias("payload_digest"),
        F.col("response.kind").alias("record_type"),
        number("original.fields").alias("refers_to"),
    )
