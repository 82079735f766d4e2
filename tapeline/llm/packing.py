"""Best-fit packing of tokenised documents into sequences, certified by dual-feasible-function lower bounds.

A document is its token ids and a closing id 0 (null or empty text: that id alone). Documents longer than a sequence are
cut into full pieces; the first piece takes the remainder. All others stay whole.

1. Pieces are dealt by a hash into groups of about `group_items`. Each group is packed by best-fit decreasing.
2. A group's sequences are counted against the largest of its dual-feasible-function bounds (the size bound, all
   threshold functions, and rounding functions). If they agree, the group is certified: no packing of it is smaller.
3. Groups with a gap open their sequences that aren't full, certified ones only their emptiest one; the pieces in these
   are exchanged, that is dealt anew into fewer groups, and packed again. After `rounds` rounds, or when one group held
   all that was open, the packing stands.

Groups have a bounded size whatever the data; only counts reach the driver. Rows that share a doc_id are packed each for
itself. Empty table: no rows. Ids are those of the `tokenizers` library with the given vocabulary file, whose content is
broadcast; a cache of words in each Python worker makes most words a dictionary lookup. Words that it lacks are merged by
`tiktoken` with the ranks of the same file (equal ids, a quarter of the time); texts that name the special token go
through `tokenizers` whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialise

LENGTH, GROUP_ITEMS, ROUNDS, CACHE_WORDS = 2048, 20_000, 4, 400_000

_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
#: The published pre-tokenisation pattern of this vocabulary, for texts of ASCII and Latin letters.
_SIMPLE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\t\n\x0b\x0c\r -~{_LATIN}]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str):
        import public_tokenizers
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_str(vocabulary)
        model = json.loads(vocabulary)
        self.special = [x["content"] for x in model.get("added_tokens", [])]
        # The vocabulary writes bytes as printable characters: those that aren't, in order, from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(byte[c] for c in word): i for word, i in model["model"]["vocab"].items() if word not in self.special}
        self.merge = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.general = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        got = np.array(self.merge(word), "<u4").tobytes()
        if len(self.cache) < CACHE_WORDS:
            self.cache[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        if any(x in text for x in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = (self.general if _OTHER.search(text) else _SIMPLE).findall(text)
        get = self.cache.get
        return b"".join([get(w) or self.word(w) for w in words])


_encoders: dict[int, Encoder] = {}


def _pieces(vocabulary, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(vocabulary.value)
        if key not in _encoders:
            _encoders[key] = Encoder(vocabulary.value)
        encode = _encoders[key]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                ends = range((n - 1) % length + 1, n + 1, length)
                rows += [(doc, i, max(0, e - length) if i else 0, e - (max(0, e - length) if i else 0), zlib.crc32(ids[4 * (max(0, e - length) if i else 0) : 4 * e])) for i, e in enumerate(ends)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for every piece of every document."""
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        _pieces(content, length), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. The tightest bin that an item fits takes it."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    frees = 0  # bit f: a bin has f free
    n = 0
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = sizes[i]
        fits = frees >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            at = open_bins[free].pop()
            if not open_bins[free]:
                frees ^= 1 << free
        else:
            free, at, n = capacity, n, n + 1
        bins[i], offsets[i] = at, capacity - free
        if free > size:
            open_bins[free - size].append(at)
            frees |= 1 << (free - size)
    return bins, offsets, n


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound on the number of bins that these dual-feasible functions give."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    mass = count * size
    best = -(-int(mass.sum()) // capacity)
    # Thresholds a: sizes above capacity - a count as a whole bin, sizes below a as nothing.
    counts, masses = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(mass)])
    half = capacity // 2
    a = np.arange(0, half + 1)
    whole = counts[-1] - counts[capacity - a + 1]
    large = counts[capacity - a + 1] - counts[half + 1]
    room = large * capacity - (masses[capacity - a + 1] - masses[half + 1])
    small = masses[half + 1] - masses[a]
    best = max(best, int((whole + large + np.maximum(0, -(-(small - room) // capacity))).max()))
    # Rounding functions: x counts as floor((k + 1) x) / k, unless (k + 1) x is whole.
    for k in range(1, 33):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (k * capacity)))
    return best


ROW_COLUMNS = ("doc_id", "piece", "start", "length", "ids_crc32")
ROW = "doc_id long, piece int, start long, length long, ids_crc32 long, "
PACKED = ROW + "grp long, bin long, offset long, bins long, bound long, reopen boolean"


def _pack(length: int):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sizes = group["length"].to_numpy()
        bins, offsets, n = best_fit_decreasing(sizes, length)
        bound = lower_bound(sizes, length)
        fill = np.bincount(bins, weights=sizes, minlength=n)
        reopen = fill < length if n > bound else np.arange(n) == fill.argmin()
        reopen &= fill < length
        return group.assign(grp=key[0], bin=bins, offset=offsets, bins=n, bound=bound, reopen=reopen[bins])

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, group_items: int = GROUP_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, certified."""
    cut = materialise(pieces(docs, vocabulary, length), "pack-pieces")
    # Full pieces are sequences already; the rest is packed.
    todo = cut.where(F.col("length") < length).withColumn("spread", F.xxhash64("doc_id", "piece", F.col("_metadata.row_index")))
    done = []
    n = todo.count()
    for turn in range(rounds):
        groups = max(1, -(-n // group_items))
        dealt = todo.withColumn("grp", F.pmod(F.xxhash64(F.lit(turn), "spread"), F.lit(groups)))
        packed = materialise(
            dealt.groupBy("grp").applyInPandas(_pack(length), PACKED.replace("grp long", "spread long, grp long")), "pack-round"
        )
        last = turn == rounds - 1 or groups == 1
        kept = packed if last else packed.where("not reopen")
        done.append(kept.select(*ROW_COLUMNS, (F.lit(turn + 1) * F.lit(1 << 58) + F.col("grp") * F.lit(1 << 26) + F.col("bin")).alias("sequence_id"), "offset", (F.col("bins") == F.col("bound")).alias("certified")))
        if last:
            break
        todo = packed.where("reopen").select(*ROW_COLUMNS, "spread")
        n = todo.count()
        if not n:
            break
    full = cut.where(F.col("length") == length)
    full = full.select(*ROW_COLUMNS, F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    out = full
    for part in done:
        out = out.union(part)
    return out
