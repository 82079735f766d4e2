"""Toxicity by class-conditional Kneser-Ney models over the two parts of a word.

A word (letters and digits, A-Z folded) is a stem, its first four bytes, and a rest. Each class, toxic and ordinary, has a
Kneser-Ney bigram model P(stem) P(rest | stem): counts are discounted, and what the discount frees goes to a lower order
that both classes share: for rests the number of distinct stems they follow, for stems the number of distinct rests
that follow them. So a rare expression is judged by its stem's class counts, and an unseen one by nearly nothing. Each
class's discount comes from its own counts of counts, n1 / (n1 + 2 n2), where n1 and n2 words occur once and twice.

A document's evidence is the difference of its two log-likelihoods per word, less the median word's difference (which is
the bias of its language or topic), and the part of it that lies well above the median; a logistic curve turns these
length-normalised figures into a score.

Counts cover every training row: labelled, and crc32 of the doc_id as text modulo 5 is not 0 (held out); but for those that fit
the curve, at most `curve_rows` rows of remainder 1, of least hash. Words are counted exactly in Spark, then summed into
tables of a fixed size by a hash of the word (2**20), stem and rest (2**17 each), which is all that the driver
gets and the executors receive; colliding words share a count. Labels, lang, source and doc_id never enter a score.

Texts meet their labels in a sort-merge join on doc_id. Several labels of a doc_id: the largest counts. Null or empty
text: no words, no evidence, the curve at zero. A null doc_id is never learned from and counts as held out. No training
rows of one class: every score is 0. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import texts
from tapeline.session import materialise

WORD_BITS, PART_BITS, STEM, CURVE_ROWS = 20, 17, 4, 20_000
CLEAR = 2.0

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False


def _parts(chunk: texts.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash of stem, rest and both for each word; index of each text's first word."""
    starts, ends, first = chunk.words(_GAP)
    middle = np.minimum(starts + STEM, ends)
    stem, rest = chunk.spans(starts, middle, fold=True), chunk.spans(middle, ends, fold=True)
    return stem, rest, texts.mix(stem * texts.K1 + rest * texts.K3), first


def _bucket(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words with their count in each class, summed over a few million words at a time."""
    held: list[tuple[np.ndarray, ...]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        word, stem, rest, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
        word, at, which = np.unique(word, return_index=True, return_inverse=True)
        bad = np.bincount(which, weights=toxic, minlength=len(word)).astype(np.int64)
        every = np.bincount(which, minlength=len(word)).astype(np.int64)
        columns = word.view(np.int64), _bucket(stem[at], PART_BITS).astype(np.int32), _bucket(rest[at], PART_BITS).astype(np.int32), bad, every - bad
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["word", "stem", "rest", "bad", "good"])

    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for chunk in texts.chunks(batch.column("text")):
            stem, rest, word, first = _parts(chunk)
            held.append((word, stem, rest, np.repeat(toxic[chunk.lo : chunk.hi].astype(bool), np.diff(first))))
            size += len(word)
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
    if size:
        yield flush()


FEATURES = ("mean", "mean_root", "clear", "clear_root", "clear_log", "words_log", "one")


class Model:
    """The two classes' log-probability differences, from tables of counts. First index: 0 ordinary, 1 toxic."""

    def __init__(self, words: np.ndarray, stems: np.ndarray, freed: np.ndarray, rests: np.ndarray, follows: np.ndarray, discount: tuple[float, float]):
        d = np.array(discount)[:, None]
        shared_stem = (rests + 0.5) / (rests + 0.5).sum()
        shared_rest = (follows + 0.5) / (follows + 0.5).sum()
        total = np.maximum(stems.sum(1, keepdims=True), 1)
        stem_p = (np.maximum(stems - d, 0) + (np.minimum(stems, d).sum(1, keepdims=True) + 0.5) * shared_stem) / (total + 0.5)
        self.stem_gap = np.log(stem_p[1] / stem_p[0]).astype(np.float32)
        self.words = np.maximum(words - d, 0).astype(np.float32)
        self.stems = (stems + 0.5).astype(np.float32)
        self.free = ((freed + 0.5) / (stems + 0.5)).astype(np.float32)  # the mass that backs off, per stem
        self.shared_rest = shared_rest.astype(np.float32)
        self.curve = np.zeros(len(FEATURES))

    def gaps(self, stem: np.ndarray, rest: np.ndarray, word: np.ndarray) -> np.ndarray:
        """log P(word | toxic) - log P(word | ordinary) of each word."""
        s, r, w = _bucket(stem, PART_BITS), _bucket(rest, PART_BITS), _bucket(word, WORD_BITS)
        p = [np.minimum(self.words[k, w], self.stems[k, s]) / self.stems[k, s] + self.free[k, s] * self.shared_rest[r] for k in (0, 1)]
        return self.stem_gap[s] + np.log(p[1] / p[0])

    def features(self, column: pa.Array) -> np.ndarray:
        """The FEATURES of each text."""
        rows = []
        for chunk in texts.chunks(column):
            stem, rest, word, first = _parts(chunk)
            gaps = self.gaps(stem, rest, word).astype(np.float64)
            n = np.diff(first)
            many = np.maximum(n, 1)
            middle = np.array([np.median(gaps[a:b]) if b > a else 0.0 for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])
            per_text = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x)])[first])  # noqa: E731, B023
            mean = per_text(gaps) / many - middle
            clear = per_text(np.maximum(gaps - np.repeat(middle, n) - CLEAR, 0))
            rows.append(np.stack([mean, mean * np.sqrt(many), clear / many, clear / np.sqrt(many), np.log1p(clear), np.log1p(n), np.ones(len(n))], 1))
        return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; columns are scaled first. The last column is the constant."""
    scale = np.maximum(x.std(0), 1e-9)
    scale[-1] = 1.0
    z, w = x / scale, np.zeros(x.shape[1])
    loss = lambda w: (np.logaddexp(0, z @ w) - y * (z @ w)).sum() + 0.05 * (w @ w)
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + 0.1 * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(len(w)), grad)
        rate = 1.0
        while rate > 1e-6 and loss(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        before, now = now, loss(w)
        if before - now < 1e-9 * max(1.0, now):
            break
    return w / scale


def _features(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = model.value.features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *(pa.array(x[:, i]) for i in range(len(FEATURES)))], ["toxic", *FEATURES])

    return run


def _discount(once: int, twice: int) -> float:
    """Kneser-Ney discount from the numbers of words that occur once and twice; half where there are none."""
    return once / (once + 2 * twice) if once + twice else 0.5


def fold(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def fit(docs: DataFrame, labels: DataFrame, curve_rows: int = CURVE_ROWS) -> Model | None:
    """Learn from the rows of `docs` (doc_id, text) that `labels` (doc_id, toxic) marks and that aren't held out."""
    spark = docs.sparkSession
    marks = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    some = materialise(marks.where(fold(5) == 1).orderBy(F.xxhash64("doc_id")).limit(curve_rows), "toxic-curve")
    counted = marks.where(fold(5) != 0).join(F.broadcast(some.select("doc_id")), "doc_id", "left_anti")
    # Merged at every size: labels grow as documents do, so a plan that broadcasts them would not last.
    marked = docs.where(fold(5) != 0).join(counted.hint("merge"), "doc_id")
    words = materialise(
        marked.select("toxic", "text").mapInArrow(_count_words, "word long, stem int, rest int, bad long, good long")
        .groupBy("word", "stem", "rest").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")),
        "toxic-words",
    )
    seen = words.agg(
        F.sum("good").alias("good"), F.sum("bad").alias("bad"),
        *(F.count_if(F.col(c) == n).alias(f"{c}{n}") for c in ("good", "bad") for n in (1, 2)),
    ).first()
    if not seen["good"] or not seen["bad"]:
        return None
    discount = tuple(_discount(seen[f"{c}1"], seen[f"{c}2"]) for c in ("good", "bad"))

    def table(key: Column, size: int, *sums: Column) -> list[np.ndarray]:
        got = words.groupBy(key.alias("k")).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).toPandas()
        out = []
        for i in range(len(sums)):
            x = np.zeros(size)
            x[got["k"].to_numpy()] = got[f"s{i}"].to_numpy()
            out.append(x)
        return out

    freed = [F.sum(F.least(F.col(c).cast("double"), F.lit(d))) for c, d in zip(("good", "bad"), discount, strict=True)]
    word = F.shiftrightunsigned(F.col("word"), 64 - WORD_BITS).cast("int")
    by_word = table(word, 1 << WORD_BITS, F.sum("good"), F.sum("bad"))
    by_stem = table(F.col("stem"), 1 << PART_BITS, F.sum("good"), F.sum("bad"), *freed, F.count(F.lit(1)))
    (follows,) = table(F.col("rest"), 1 << PART_BITS, F.count(F.lit(1)))
    model = Model(np.stack(by_word), np.stack(by_stem[:2]), np.stack(by_stem[2:4]), by_stem[4], follows, discount)
    shared = spark.sparkContext.broadcast(model)
    columns = "toxic int, " + ", ".join(f"{c} double" for c in FEATURES)
    sample = docs.where(fold(5) == 1).join(some, "doc_id").select("toxic", "text").mapInArrow(_features(shared), columns).toPandas()
    if sample["toxic"].nunique() < 2:
        return None
    model.curve = _logistic(sample[list(FEATURES)].to_numpy(), sample["toxic"].to_numpy().astype(float))
    return model


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if m is None:
                score = np.zeros(batch.num_rows)
            else:
                score = 1 / (1 + np.exp(-np.clip(m.features(batch.column("text")) @ m.curve, -30, 30)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = fit(rows, labels, **options)
    held = F.coalesce(fold(5) == 0, F.lit(True))
    return rows.select("doc_id", held.alias("held_out"), "text").mapInArrow(
        _score(spark.sparkContext.broadcast(model)), "doc_id long, held_out boolean, score double, predicted int"
    )
