"""Byte pipes: raw chunks with offsets, and the lines that they hold, wherever chunks were cut."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeline.functions.text import LINE_BREAKS

CHUNK = "pipe {pipe}, at long, chunk binary"
#: Buckets of pipes; bytes (of a cut line, characters) of a pipe that its bucket holds; bytes of a pipe whose early chunks are one entry.
BUCKETS, HELD, BLOCK = 1 << 14, 1 << 14, 1 << 16
_BREAK = re.compile(f"[{LINE_BREAKS}]")
_LINES = Row("pipe", "first", "lines")


def read_chunks(spark: SparkSession, folder: str, pipe: str = "long", files_per_batch: int = 100) -> DataFrame:
    """A stream of chunks from the Parquet files that appear in a folder of any store: `pipe` (of the type given), `at` (the
    offset of the chunk's first byte), `chunk`. An empty chunk says that its pipe has ended there."""
    return spark.readStream.schema(CHUNK.format(pipe=pipe)).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def chunked(df: DataFrame, pipe: str, data: Column, around: int = 512) -> DataFrame:
    """The bytes of each row as chunks of 0 to 2 `around` bytes, cut by a hash wherever that falls, and the empty one at the end."""
    size = F.octet_length("_data")
    rows = df.select(F.col(pipe).alias("pipe"), data.alias("_data")).where("_data is not null")
    inner = F.transform(F.sequence(F.lit(0), F.floor(size / around).cast("int")), lambda i: F.least(size, i * around + F.pmod(F.hash("pipe", i), F.lit(around))))
    cuts = rows.withColumn("_cuts", F.array_distinct(F.concat(F.array(F.lit(0)), inner, F.array(size))))
    spans = cuts.select("pipe", "_data", F.explode(F.arrays_zip(F.col("_cuts").alias("a"), F.slice("_cuts", 2, F.size("_cuts")).alias("b"))).alias("s"))
    start, end = F.col("s.a"), F.coalesce("s.b", "s.a")  # the last span is empty
    return spans.select("pipe", start.cast("long").alias("at"), F.substring("_data", start + 1, end - start).alias("chunk"))


class Reassembler(StatefulProcessor):
    """Lines of each pipe, numbered from 0: those of a batch as one array with the number of the first. Between batches the state keeps what has come too early (by offset), the bytes of a
    character that is cut, and the pieces of a line that is cut. Chunks that come again, whole or in part, count once. Bytes that
    aren't UTF-8 become U+FFFD. A pipe's last line comes with the empty chunk at its end.

    Each call for state goes to the JVM and back, so a key is a bucket of pipes and what it holds of them is one value. Of a pipe
    with more than `held` bytes too early, or as many characters of a cut line, these go to maps of their own, early chunks by blocks of
    `block` bytes of the pipe: a batch reads again the blocks that it has reached, and no line before it is whole."""

    def __init__(self, kind: str, held: int = HELD, block: int = BLOCK):
        self.kind, self.held, self.block = kind, held, block

    def init(self, handle: StatefulProcessorHandle) -> None:
        chunks = "array<struct<at: bigint, chunk: binary>>"
        pipe = f"pipe: {self.kind}, next: bigint, line: bigint, cut: binary, piece: string, pieces: bigint, early: {chunks}, blocks: array<struct<block: bigint, first: bigint>>"
        self.open = handle.getValueState("open", f"pipes array<struct<{pipe}>>")
        self.ended = handle.getValueState("ended", f"pipes array<{self.kind}>")
        self.early = handle.getMapState("early", f"pipe {self.kind}, block long", f"chunks {chunks}")
        self.pieces = handle.getMapState("pieces", f"pipe {self.kind}, n long", "piece string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        came: dict[object, dict[int, bytes]] = {}
        for row in rows:
            _longest(came.setdefault(row.pipe, {}), [(row.at, row.chunk)])
        (ended,), (held,) = self.ended.get() or ((),), self.open.get() or ((),)
        over, pipes = set(ended), {p[0]: _plain(p) for p in held}
        for pipe in came.keys() - over:
            before = pipes.get(pipe) or (pipe, 0, 0, b"", "", 0, [], [])
            pipes[pipe], whole = self._taken(before, came[pipe])
            if whole:
                yield _LINES(pipe, before[2], whole)
            if pipes[pipe] is None:
                del pipes[pipe]
                over.add(pipe)
        if pipes:
            self.open.update((list(pipes.values()),))
        elif held:
            self.open.clear()
        if len(over) > len(ended):
            self.ended.update((list(over),))

    def _taken(self, state: tuple, came: dict[int, bytes]) -> tuple[tuple | None, list[str]]:
        """What the state of a pipe becomes (None if it has ended), and its lines that are whole now."""
        pipe, after, line, cut, piece, n_pieces, early, blocks = state
        waiting, first = dict(early), dict(blocks)
        _longest(waiting, came.items())
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        decoder.setstate((cut, 0))
        pieces, whole, ends = [piece] if piece else [], [], set()

        def finished(last: str) -> None:
            nonlocal pieces, n_pieces, line
            before = [self.pieces.getValue((pipe, n))[0] for n in range(n_pieces)]
            for n in range(n_pieces):
                self.pieces.removeKey((pipe, n))
            whole.append("".join([*before, *pieces, last]))
            line, pieces, n_pieces = line + 1, [], 0

        offsets = [*waiting]
        heapify(offsets)
        while True:
            for block in [b for b, at in first.items() if at <= after]:
                chunks = self._block(pipe, block)
                self.early.removeKey((pipe, block))
                del first[block]
                for at in chunks.keys() - waiting.keys():
                    heappush(offsets, at)
                _longest(waiting, chunks.items())
            if not offsets or offsets[0] > after:
                break
            chunk = waiting.pop(at := heappop(offsets))
            if not chunk:
                ends.add(at)
            text = decoder.decode(chunk[after - at :])
            after = max(after, at + len(chunk))
            *ready, rest = _BREAK.split(text)
            for x in ready:
                finished(x)
            if rest:
                pieces.append(rest)
        if after in ends:
            finished(decoder.decode(b"", True))
            for block in first:
                self.early.removeKey((pipe, block))
            return None, whole
        if sum(map(len, waiting.values())) > self.held:
            by_block: dict[int, dict[int, bytes]] = {}
            for at, chunk in waiting.items():
                by_block.setdefault(at // self.block, {})[at] = chunk
            for block, chunks in by_block.items():
                if block in first:
                    _longest(chunks, self._block(pipe, block).items())
                self.early.updateValue((pipe, block), (sorted(chunks.items()),))
                first[block] = min(chunks)
            waiting = {}
        piece = "".join(pieces)
        if len(piece) > self.held:
            self.pieces.updateValue((pipe, n_pieces), (piece,))
            piece, n_pieces = "", n_pieces + 1
        return (pipe, after, line, decoder.getstate()[0], piece, n_pieces, sorted(waiting.items()), sorted(first.items())), whole

    def _block(self, pipe, block: int) -> dict[int, bytes]:
        return {at: bytes(chunk) for at, chunk in self.early.getValue((pipe, block))[0]}

    def close(self) -> None: ...


def _longest(chunks: dict[int, bytes], more: Iterable[tuple[int, bytes]]) -> None:
    for at, chunk in more:
        if at not in chunks or len(chunk) > len(chunks[at]):
            chunks[at] = bytes(chunk)


def _plain(state: tuple) -> tuple:
    """A pipe's state as it is written: state gives rows and bytearrays."""
    *rest, early, blocks = state
    rest[3] = bytes(rest[3])
    return (*rest, [(at, bytes(chunk)) for at, chunk in early], [tuple(x) for x in blocks])


def lines(chunks: DataFrame, buckets: int = BUCKETS, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """`pipe`, `line_no` and `line` of a stream of chunks, each line once, when it is whole. A bucket of pipes is one key of the state: what
    comes of one bucket in a batch is one task's work. The state of a pipe is bounded by its unfinished line and what came early; of a
    pipe that has ended its name stays. A checkpoint holds for one number of buckets."""
    kind = dict(chunks.dtypes)["pipe"]
    dealt = chunks.withColumn("_bucket", F.pmod(F.xxhash64("pipe"), F.lit(buckets)).cast("int"))
    # A row for each pipe and batch, not for each line, comes back from Python.
    got = dealt.groupBy("_bucket").transformWithState(Reassembler(kind, held, block), f"pipe {kind}, first long, lines array<string>", "Append", "None")
    return got.select("pipe", "first", F.posexplode("lines").alias("at", "line")).select("pipe", (F.col("first") + F.col("at")).alias("line_no"), "line")
