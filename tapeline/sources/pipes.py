"""What programs print, standard output and errors in one pipe, as chunks of bytes."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST = 1 << 16


def outputs(commands: DataFrame) -> DataFrame:
    """Run each row's program (`argv`, an array of strings) on an executor and read its pipe until it is empty: `pipe`, `at`,
    `chunk` as they came, then an empty chunk with the program's exit `code`. A program that can't be started gives its
    message and code 127. A task that runs again runs its programs again."""
    kind = dict(commands.dtypes)["pipe"]
    schema = pa.schema([("at", pa.int64()), ("chunk", pa.binary()), ("code", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, argv in enumerate(batch.column("argv").to_pylist()):
                at = 0
                for chunk, code in _chunks(argv or []):
                    row = pa.record_batch([[at], [chunk], [code]], schema=schema)
                    yield pa.RecordBatch.from_arrays([batch.column("pipe").slice(i, 1), *row.columns], ["pipe", *schema.names])
                    at += len(chunk)

    return commands.select("pipe", F.col("argv").cast("array<string>")).mapInArrow(run, f"pipe {kind}, at long, chunk binary, code int")


def _chunks(argv: list[str]) -> Iterator[tuple[bytes, int | None]]:
    try:
        process = subprocess.Popen(argv, stdin=subprocess.DEVNULL, stdout=subprocess.PIPE, stderr=subprocess.STDOUT)
    except (OSError, IndexError, TypeError) as e:
        yield f"{type(e).__name__}: {e}\n".encode(), None
        yield b"", 127
        return
    with process:
        while chunk := process.stdout.read1(MOST):
            yield chunk, None
    yield b"", process.returncode
