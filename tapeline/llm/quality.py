"""Quality rules with adaptive thresholds from mergeable quantile sketches per language and source.

Every document gets counts over its whole text (null text: no words): words, code points in words, symbols, repeated
lines, words in repeated 3-word windows, upper-case words. Each rate is taken as log((count + 1/2) / (of + 1)), so that
a document without any is judged by how much text it has, and a few occurrences in a short text are not a high rate; word length is
taken as its logarithm. These figures go into KLL sketches, one per (lang, source) and figure. A fence lies `reach`
interquartile ranges beyond the quartile of the sketch. Most documents have no repeated line at all, so that such a range says
more about their lengths than about repetition: the fence of a rate also lies no further from the upper quartile than `near`
of the way to the most that a document can have and pass the base rule (BOUNDS), so each figure can reject. No fixed cutoff or
least spread stands beside it. A source's fence
is averaged with its language's, and that with the fence of all documents, weighted by rows with the coarser one as
`prior` rows: the same rule for a source of three documents and of three billion. A document stays unless a base
rule fails (under 50 words, or over half of its words in repeated windows) or a figure lies beyond its fence. Null lang
and null source are groups of their own.

Partial sketches are built before the shuffle, so a source of any size sends one small sketch per task; the thresholds
(a row per group) are joined back by key. Documents without words have no figures and fail the base rule. Empty table: no
rows. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import texts
from tapeline.session import materialise

#: Each rate: what is counted, and of what.
RATES = {"symbols": ("n_symbols", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words"), "upper": ("n_upper", "n_words")}
FIGURES = ("word_length", *RATES)
REACH, LENGTH_REACH, NEAR, PRIOR, SKETCH_K = 2.5, 6.0, 0.9, 20, 1024
#: The most of each rate, as a logarithm: all of it, but half of the words in repeated windows, beyond which the base rule fails.
BOUNDS = {"symbols": 0.0, "dup_lines": 0.0, "repeats": math.log(0.5), "upper": 0.0}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LOWER, _UPPER = np.zeros(256, bool), np.zeros(256, bool)
_LOWER[97:123], _UPPER[65:91] = True, True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: does it occur again anywhere, and did it occur before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    often, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    before[order[1:][same]] = True
    return often, before


def _counts(chunk: texts.Chunk) -> list[np.ndarray]:
    data, offsets, rows = chunk.data, chunk.offsets, len(chunk.offsets) - 1
    starts, ends, first = chunk.words()
    inside = ~texts.SPACE[data]
    owner = np.repeat(np.arange(rows), np.diff(first))
    # 3-word windows; those that reach into the next text are left out.
    h = chunk.spans(starts, ends, fold=False)
    covered = np.zeros(len(starts), bool)
    if len(starts) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        often, _ = _repeated(texts.mix(texts.windows(h, 3)[at] + owner[at].astype(np.uint64) * texts.K2))
        for i in range(3):
            covered[at[often] + i] = True
    # Lines: cut at \n and at the ends of texts; those without a word don't count.
    cuts = np.unique(np.concatenate([np.flatnonzero(data == 10), offsets - 1]))
    from_, to = np.concatenate([cuts[:-1] + 1]), cuts[1:]
    to = np.where(np.isin(to, offsets[1:] - 1) & (data[np.minimum(to, len(data) - 1)] != 10), to + 1, to) if len(data) else to
    used = np.searchsorted(starts, to) > np.searchsorted(starts, from_)
    from_, to = from_[used], to[used]
    line_owner = np.searchsorted(offsets, from_, "right") - 1
    _, before = _repeated(texts.mix(chunk.spans(from_, to, fold=False) + line_owner.astype(np.uint64) * texts.K2))
    lower, upper = np.concatenate([[0], np.cumsum(_LOWER[data])]), np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = (lower[ends] == lower[starts]) & (upper[ends] - upper[starts] > 1)
    by_row = lambda owners: np.bincount(owners, minlength=rows)
    return [
        np.diff(first), _per_text(inside & ((data & 0xC0) != 0x80), offsets), _per_text(_SYMBOL[data], offsets),
        by_row(line_owner), by_row(line_owner[before]), by_row(owner[covered]), by_row(owner[shout]),
    ]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = [_counts(c) for c in texts.chunks(batch.column("text"))]
        columns = [np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * len(COUNTS)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("lang"), batch.column("source"), *map(pa.array, columns)], ["doc_id", "lang", "source", *COUNTS]
        )


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of each document."""
    keys = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source")]
    return docs.select(*keys, F.col("text").cast("string").alias("text")).mapInArrow(
        _count_batches, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    )


def _figures() -> dict[str, Column]:
    words = F.col("n_words") > 0
    rates = {c: F.when(words, F.ln((F.col(count) + 0.5) / (F.col(of) + 1))) for c, (count, of) in RATES.items()}
    return {"word_length": F.when(words, F.ln(F.col("word_chars") / F.col("n_words")))} | rates


def _fences(sketches: DataFrame, reach: float, length_reach: float, near: float) -> DataFrame:
    """The sketches' fences, as columns <figure>_min and <figure>_max in place of the sketches."""
    for c in FIGURES:
        sketches = sketches.withColumn(c, F.kll_sketch_get_quantile_double(c, F.array(F.lit(0.25), F.lit(0.75))))
        low, high = F.col(c)[0], F.col(c)[1]
        wide = (length_reach if c == "word_length" else reach) * (high - low)
        most = high + wide if c == "word_length" else F.least(high + wide, high + near * (BOUNDS[c] - high))
        sketches = sketches.withColumn(f"{c}_min", low - wide).withColumn(f"{c}_max", most)
    return sketches.drop(*FIGURES)


#: Rates have outliers above, word length on both sides.
SIDES = ("word_length_min", *(f"{c}_max" for c in FIGURES))


def thresholds(measured: DataFrame, reach: float = REACH, length_reach: float = LENGTH_REACH, near: float = NEAR, prior: int = PRIOR, k: int = SKETCH_K) -> DataFrame:
    """A row per (lang, source): the fences of every figure."""
    figures = measured.select("lang", "source", *(v.cast("double").alias(c) for c, v in _figures().items()))
    groups = materialise(
        figures.where("word_length is not null").groupBy("lang", "source")
        .agg(F.count(F.lit(1)).alias("rows"), *(F.kll_sketch_agg_double(c, k).alias(c) for c in FIGURES)),
        "quality-sketches",
    )
    fences = lambda by: _fences(groups.groupBy(*by).agg(F.sum("rows").alias("rows"), *(F.kll_merge_agg_double(c, k).alias(c) for c in FIGURES)), reach, length_reach, near)
    renamed = lambda df, tag: df.select(*(F.col(c).alias(tag + c) for c in df.columns))
    own, langs, every = _fences(groups, reach, length_reach, near), renamed(fences(["lang"]), "l_"), renamed(fences([]), "e_")
    joined = own.join(langs, own.lang.eqNullSafe(F.col("l_lang"))).join(F.broadcast(every), F.lit(True))
    meet = lambda n, fine, coarse: (n * fine + prior * coarse) / (n + prior)
    both = [F.round(meet(F.col("rows"), F.col(c), meet(F.col("l_rows"), F.col(f"l_{c}"), F.col(f"e_{c}"))), 3).alias(c) for c in SIDES]
    return joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), *both)


def judged(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, kept."""
    measured = materialise(counts(docs), "quality-counts")
    fences = thresholds(measured, **options)
    joined = measured.join(fences, measured.lang.eqNullSafe(F.col("t_lang")) & measured.source.eqNullSafe(F.col("t_source")), "left")
    outlier = F.lit(False)
    for side in SIDES:
        figure = _figures()[side.rpartition("_")[0]]
        outlier = outlier | F.coalesce(figure < F.col(side) if side.endswith("_min") else figure > F.col(side), F.lit(False))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~outlier).alias("kept")
    )
