"""Importance resampling towards a target distribution, over hashed runs of words.

A text is lower-cased (A-Z only) and cut by an untrained `Split` pre-tokeniser into words with their offsets. Runs of one to
`widest` words, joined by one space and told apart by their offset pairs, fall into buckets by the CRC-32 of their UTF-8
bytes. Each bucket's gain is the log-ratio of its share in the target and in the corpus, both with one count added. A
document's weight is the mean of its runs' gains; Gumbel noise from a hash of its doc_id makes the highest scores a sample
without replacement.

Texts are read once: the buckets of each document are written (about 14 bits a run) and both the histogram and the weights
come from there. What reaches the driver is one number per bucket, whatever the corpus. Ranks come from sorted ranges.

Null or empty texts have no words, weight 0 and no rank. A null doc_id draws its noise as an empty one. Documents of equal
score rank by doc_id (null last), then by runs and by their place in the files, so repeated rows get different ranks. An
empty corpus or target is counted as all zeros. Columns beside doc_id and text are not read. Texts of any length are cut into
pieces between words; a piece holds about a million characters, or one word that is longer. Bytes that aren't UTF-8 are skipped.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import texts
from tapeline.llm.common import LOWER, PLACE, UPPER, every, fresh
from tapeline.llm.exact_dedup import located
from tapeline.operators.ordering import with_index
from tapeline.session import materialise

WIDEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: A word: digits, lower-case letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
PIECE = 1 << 20
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def _zero_bytes() -> list[np.ndarray]:
    """For each k, what 2^k zero bytes behind a text do to its CRC-32: a table for each of its four bytes."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    table = np.array([step, *(np.arange(256, dtype=np.uint32) << np.uint32(8 * i - 8) for i in (1, 2, 3))], np.uint32)
    out = [table]
    for _ in range(31):
        out.append(np.array([_through(out[-1], row) for row in out[-1]], np.uint32))
    return out


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][(crc >> 8) & 255] ^ table[2][(crc >> 16) & 255] ^ table[3][crc >> 24]


_ZEROS = _zero_bytes()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row, from their CRCs and the second one's length."""
    out = first.copy()
    for k in range(int(length.max(initial=0)).bit_length()):
        at = np.flatnonzero((length >> k) & 1)
        out[at] = _through(_ZEROS[k], out[at])
    return out ^ second


class Numbers(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = len(self)
        return len(self) - 1


class Words:
    """Distinct words of some texts by number, from an untrained pre-tokeniser."""

    def __init__(self) -> None:
        from tokenizers import PreTokenizedString, Regex, pre_tokenizers

        self.held, self.split = PreTokenizedString, pre_tokenizers.Split(Regex(WORD), "removed", invert=True)
        self.number = Numbers()

    def pieces(self, text: str) -> Iterator[str]:
        """`text` in parts of about PIECE characters, cut before a character that is in no word."""
        at = 0
        while len(text) - at > PIECE and (found := _BETWEEN.search(text, at + PIECE)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:]

    def of(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and its offset pair in the bytes of `text`."""
        numbers, pairs, before = [], [np.zeros((0, 2), np.int64)], 0
        for piece in self.pieces(text.translate(_FOLD).decode("utf-8", "ignore")):
            cut = self.held(piece)
            self.split.pre_tokenize(cut)
            if got := cut.get_splits(offset_referential="original", offset_type="byte"):
                words, at, _ = zip(*got, strict=True)
                numbers += map(self.number.__getitem__, words)
                pairs.append(before + np.fromiter(itertools.chain.from_iterable(at), np.int64, 2 * len(at)).reshape(-1, 2))
            before += len(piece.encode())
        return np.array(numbers, np.int64), np.concatenate(pairs)

    def checks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word: its CRC-32, that of a space and the word, and the bytes of these."""
        coded = [x.encode() for x in self.number]
        plain, spaced = [zlib.crc32(x) for x in coded], [zlib.crc32(b" " + x) for x in coded]
        return np.array(plain, np.uint32), np.array(spaced, np.uint32), np.array([len(x) + 1 for x in coded], np.int64)


def _windows(chunk: texts.Chunk, widest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each run that starts at each word (-1: it would leave its document), and the words of each document."""
    words, raw, at = Words(), chunk.data.tobytes(), chunk.offsets.tolist()
    found = [words.of(raw[a:b]) for a, b in itertools.pairwise(at)]
    number = np.concatenate([x for x, _ in found])
    starts, ends = np.concatenate([a + x for a, (_, x) in zip(at, found, strict=False)]).T
    plain, spaced, length = words.checks()
    limit = chunk.offsets[np.searchsorted(chunk.offsets, starts, "right")] if len(starts) else ends  # where each word's document ends
    runs = np.full((len(number), widest), -1, np.int64)
    crc = plain[number]
    for k in range(min(widest, len(number))):
        if k:  # a window from the first word's offset pair to that of the word k on
            crc = joined_crc(crc[:-1], spaced[number[k:]], length[number[k:]])
        runs[: len(crc), k] = np.where(ends[k:] <= limit[: len(crc)], crc.astype(np.int64) % buckets, -1)
    return runs, np.diff(np.searchsorted(starts, chunk.offsets))


def _buckets(widest: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in texts.chunks(batch.column("text")):
                runs, sizes = _windows(chunk, widest, buckets)
                kept = runs >= 0
                before = np.concatenate([[0], np.cumsum(kept.sum(1))])[np.concatenate([[0], np.cumsum(sizes)])]
                lists = pa.ListArray.from_arrays(pa.array(before, pa.int32()), pa.array(runs[kept], pa.int32()))
                rows = batch.slice(chunk.lo, chunk.hi - chunk.lo)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("place"), pa.array(sizes, pa.int64()), lists], ["doc_id", "place", "n_words", "buckets"])

    return run


def hashed_runs(docs: DataFrame, place: Column, widest: int = WIDEST, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, place, n_words, and the bucket of each run of words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_buckets(widest, buckets), f"doc_id long, place {PLACE}, n_words long, buckets array<int>")


def histogram(runs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Number of runs in each bucket: a sum per task, then over tasks; one number per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("buckets").flatten().to_numpy(), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for row in runs.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A thousandfold log-ratio for each bucket, rounded down."""
    b, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + b) / ((x + 1.0) * (t + b)))) for x, y in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigh(gain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = gain.value
        for batch in batches:
            lists = batch.column("buckets")
            n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sums = np.concatenate([[0], np.cumsum(g[lists.flatten().to_numpy()])])
            ends = np.cumsum(n)
            weight = (sums[ends] - sums[ends - n]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), batch.column("n_words"), pa.array(n), pa.array(weight)], ["doc_id", "place", "n_words", "n_features", "weight"]
            )

    return run


def _resampled(docs: DataFrame, place: Column, target: DataFrame, percent: int, least_words: int, seed: int, widest: int, buckets: int) -> DataFrame:
    spark = docs.sparkSession
    runs = materialise(hashed_runs(docs, place, widest, buckets), "runs")
    wanted = hashed_runs(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), F.lit(None).cast(PLACE), widest, buckets)
    gain = spark.sparkContext.broadcast(gains(histogram(runs, buckets), histogram(wanted, buckets)))  # one number per bucket
    weighed = runs.mapInArrow(_weigh(gain), f"doc_id long, place {PLACE}, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    scored = weighed.withColumn("score", (F.col("weight") + noise).cast("long")).withColumn("short", F.col("n_words") < least_words)
    indexed = with_index(scored, F.col("short").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("place").asc(), name="rank")
    indexed = materialise(indexed, "ranked")
    drawn = percent * indexed.where("not short").count() // 100
    return indexed.withColumn("rank", F.when(~F.col("short") & (F.col("rank") <= drawn), F.col("rank"))).drop("short")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, widest: int = WIDEST, buckets: int = BUCKETS
) -> DataFrame:
    """One row per document of `docs`: doc_id, n_words, n_features, weight, score, and the rank of those drawn, which are
    `percent` of the documents with at least `least_words` words."""
    docs, place = located(docs)
    return _resampled(docs, place, target, percent, least_words, seed, widest, buckets).drop("place")


def drawn(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **options) -> DataFrame:
    """The rows of `docs` that `resample` draws, each by itself, whatever its doc_id."""
    options = {"least_words": LEAST_WORDS, "seed": SEED, "widest": WIDEST, "buckets": BUCKETS} | options
    docs, place = located(docs)
    name, own = fresh(docs, "drawn_place"), fresh(docs, "own_place")
    chosen = _resampled(docs, place, target, percent, **options).where("rank is not null").select(F.col("place").alias(name))
    return docs.withColumn(own, place).join(chosen.hint("merge"), F.col(own) == F.col(name), "left_semi").select(*every(docs))
