"""Words and their 64-bit hashes for the texts of an Arrow batch, by NumPy over the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_rng = np.random.Generator(np.random.PCG64(20240613))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
K1, K2, K3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))
#: ASCII white space: the characters that end a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: every bit of the result depends on every bit of `h`."""
    h = h ^ (h >> np.uint64(30))
    h = h * K1
    h ^= h >> np.uint64(27)
    h *= K2
    h ^= h >> np.uint64(31)
    return h


class Chunk:
    """Some consecutive texts: rows [lo, hi) of the batch, their bytes, and the offsets of each text in these."""

    def __init__(self, lo: int, hi: int, data: np.ndarray, offsets: np.ndarray):
        self.lo, self.hi, self.data, self.offsets = lo, hi, data, offsets

    def spans(self, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
        """A hash of each byte span; `fold` lower-cases A-Z."""
        power, back = _power(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((_FOLDED if fold else _BYTE)[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * K3)

    def words(self, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the index of each text's first word (one more at the end). `space` flags the
        bytes that are in no word."""
        full = ~space[self.data]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        first = full.copy()
        first[1:] &= ~full[:-1]
        first[inner] = full[inner]
        last = full.copy()
        last[:-1] &= ~full[1:]
        last[inner - 1] = full[inner - 1]
        starts = np.flatnonzero(first)
        return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, self.offsets)


def chunks(column: pa.Array, most_bytes: int = 1 << 21) -> Iterator[Chunk]:
    """The texts of a string column (null: empty) in pieces of about `most_bytes`; one text is never divided."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1)
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most_bytes, "right")) - 1)
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """The hash of the `width` words from each word on (width - 1 fewer than words)."""
    if not 0 < width <= len(h):
        return np.zeros(0, np.uint64)
    last = len(h) - width + 1
    out = h[:last]
    for i in range(1, width):
        out = out * K1 + h[i : last + i]
    return mix(out)
