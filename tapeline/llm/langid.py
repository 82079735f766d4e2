"""Language identification by error-correcting output codes over byte trigrams.

Every language learned has a codeword: all 2**(K-1) - 1 distinct splits of up to six languages, else a seeded random
code. For each bit a binary n-gram classifier tells the languages with a 1 from those with a 0: smoothed log-odds of
hashed trigrams (letters only, A-Z folded), every language weighing alike. Counts come from all training rows. A second
pass over them measures how often each bit is right; its log-odds weigh the bit's logistic loss, and decoding takes the
codeword of least weighted loss. The score is that codeword's share of exp(-loss); below `ambiguous_below` the row is
flagged ambiguous.

Training rows: non-null lang, and crc32 of the doc_id as text modulo 3 is not 1. Null text, or none with a letter: `und`,
score 0. No training rows: `und` for all. Rows are dropped one by one, whatever their doc_id. A null doc_id is never learned from and counts as held out. Empty table: no
rows. Repeated rows get the same answer. Of languages with equal loss the first by name counts. The driver gets one count per
language and bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import texts
from tapeline.llm.common import PLACE, without
from tapeline.llm.exact_dedup import located

BITS, AMBIGUOUS_BELOW, EVIDENCE = 13, 0.5, 400
UNKNOWN = "und"

_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def trigrams(chunk: texts.Chunk) -> Iterator[np.ndarray]:
    """The counts of hashed trigrams of each text."""
    x = _FOLD[chunk.data]
    size = 1 << BITS
    if len(x) < 3:
        for _ in range(len(chunk.offsets) - 1):
            yield np.zeros(size, np.int64)
        return
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F)
    h >>= np.uint32(32 - BITS)
    h[(x[:-2] == 32) & (x[1:-1] == 32) | (x[1:-1] == 32) & (x[2:] == 32)] = 0  # runs of other characters are one bucket
    for a, b in zip(chunk.offsets[:-1].tolist(), chunk.offsets[1:].tolist(), strict=True):
        got = np.bincount(h[a : max(a, b - 2)], minlength=size)
        got[0] = 0
        yield got


def _count_languages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = iter(batch.column("lang").to_pylist())
        for chunk in texts.chunks(batch.column("text")):
            for got in trigrams(chunk):
                lang = next(langs)
                sums[lang] = sums[lang] + got if lang in sums else got
    for lang, got in sums.items():
        at = np.flatnonzero(got)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(got[at], pa.int64())], ["lang", "bucket", "n"])


def codewords(k: int) -> np.ndarray:
    """A row of -1 and 1 for each of k languages."""
    if k <= 1:
        return np.ones((k, 1), np.int8)
    if k <= 6:
        columns = [[1] + [1 if (c >> (i - 1)) & 1 else -1 for i in range(1, k)] for c in range(2 ** (k - 1) - 1)]
        return np.array(columns, np.int8).T
    bits = math.ceil(12 * math.log2(k))
    rng = np.random.Generator(np.random.PCG64(k))
    best, most = None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (k, bits))
        code[:, np.abs(code.sum(0)) == k] *= np.where(np.arange(k) % 2, -1, 1).astype(np.int8)[:, None]
        apart = (bits - (code.astype(int) @ code.T.astype(int))) // 2
        apart[np.arange(k), np.arange(k)] = bits
        if apart.min() > most:
            best, most = code, apart.min()
    return best


class Model:
    """Languages, codewords, a weight per trigram and bit, and a weight per bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        share = (counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)
        self.weights = np.zeros((counts.shape[1], self.code.shape[1]), np.float32)
        for b in range(self.code.shape[1]):
            one, zero = share[self.code[:, b] > 0], share[self.code[:, b] < 0]
            if len(one) and len(zero):
                self.weights[:, b] = np.log(one.mean(0)) - np.log(zero.mean(0))
        self.trust = np.ones(self.code.shape[1])

    def margins(self, got: np.ndarray) -> np.ndarray:
        """Each bit's log-odds; evidence beyond EVIDENCE trigrams only lowers the variance."""
        at = np.flatnonzero(got)
        n = got[at].sum()
        return (got[at].astype(np.float32) @ self.weights[at]) * min(1.0, EVIDENCE / max(n, 1)) / 4 if n else np.zeros(self.code.shape[1], np.float32)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best language and its share, for rows of margins."""
        losses = (np.logaddexp(0, -self.code[None] * margins[:, None, :]) * self.trust).sum(2) / self.trust.sum() * math.sqrt(self.code.shape[1])
        share = np.exp(-(losses - losses.min(1, keepdims=True)))
        share /= share.sum(1, keepdims=True)
        return losses.argmin(1), share.max(1)


def _hits(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, right, rows = model.value, 0, 0
        number = {x: i for i, x in enumerate(m.langs)}
        for batch in batches:
            langs = iter(batch.column("lang").to_pylist())
            for chunk in texts.chunks(batch.column("text")):
                margins = np.array([m.margins(got) for got in trigrams(chunk)])
                want = m.code[[number[next(langs)] for _ in range(len(margins))]]
                right, rows = right + (margins * want > 0).sum(0), rows + len(margins)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(right)), pa.int32()), pa.array(right, pa.int64()), pa.array([rows] * len(right), pa.int64())], ["bit", "hits", "rows"])

    return run


def fit(training: DataFrame) -> Model | None:
    """Learn from all rows of `training` (lang, text)."""
    spark = training.sparkSession
    counts = training.mapInArrow(_count_languages, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    if not langs:
        return None
    table = np.zeros((len(langs), 1 << BITS))
    table[counts["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(), counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    model = Model(langs, table)
    known = training.where(F.col("lang").isin(langs))
    hits = known.mapInArrow(_hits(spark.sparkContext.broadcast(model)), "bit int, hits long, rows long").groupBy("bit").agg(F.sum("hits").alias("hits"), F.sum("rows").alias("rows"))
    for row in hits.collect():
        rate = (row["hits"] + 1) / (row["rows"] + 2)
        model.trust[row["bit"]] = max(0.05, math.log(rate / (1 - rate))) if rate < 1 else 1.0
    return model


def _predict(model, ambiguous_below: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            langs, scores = [], []
            for chunk in texts.chunks(batch.column("text")):
                if m is not None:
                    best, share = m.decode(np.array([m.margins(got) for got in trigrams(chunk)]).reshape(len(chunk.offsets) - 1, -1))
                ascii_ = np.concatenate([[0], np.cumsum(_LETTER[chunk.data])])[chunk.offsets]
                for i in range(len(chunk.offsets) - 1):
                    lettered = ascii_[i + 1] > ascii_[i] or any(map(str.isalpha, chunk.data[chunk.offsets[i] : chunk.offsets[i + 1]].tobytes().decode("utf-8", "replace")))
                    known = lettered and m is not None
                    langs.append(m.langs[best[i]] if known else UNKNOWN)
                    scores.append(float(share[i]) if known else 0.0)
            flags = [s < ambiguous_below for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())],
                ["doc_id", "place", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return run


def _identified(docs: DataFrame, place: Column, ambiguous_below: float) -> DataFrame:
    spark = docs.sparkSession
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out")
    )
    model = fit(rows.where("not held_out and lang is not null").select("lang", "text"))
    return rows.select("doc_id", "place", "held_out", "text").mapInArrow(
        _predict(spark.sparkContext.broadcast(model), ambiguous_below), f"doc_id long, place {PLACE}, held_out boolean, lang_pred string, score double, ambiguous boolean"
    )


def identify(docs: DataFrame, ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, ambiguous."""
    return _identified(docs, F.lit(None).cast(PLACE), ambiguous_below).drop("place")


def drop_unidentified(docs: DataFrame, ambiguous_below: float = AMBIGUOUS_BELOW) -> DataFrame:
    """The rows of `docs` with a language: neither `und` nor ambiguous. Each row by itself, whatever its doc_id."""
    docs, place = located(docs)
    return without(docs, place, _identified(docs, place, ambiguous_below).where(f"lang_pred = '{UNKNOWN}' or ambiguous").select("place"))
