import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tapeline.llm import importance as x
from tapeline.llm.common import LOWER, UPPER

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, widest=2):
    w = WORDS.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
    return len(w), [" ".join(w[i : i + k + 1]) for i in range(len(w)) for k in range(widest) if i + k < len(w)]


def plain(docs, target, percent=25, least=20, seed=7, widest=2, buckets=10_000):
    """The contract, one row after the other."""
    at = lambda run: zlib.crc32(run.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for table, out in ((docs, s), (target, t)):
        for _, text in table:
            for run in runs(text, widest)[1]:
                out[at(run)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (sum(s) + buckets) / ((s[b] + 1.0) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, text in docs:
        n, got = runs(text, widest)
        weight = math.floor(sum(gain[at(r)] for r in got) / len(got)) if got else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(got), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    cut = percent * len(order) // 100
    return sorted(repr((*r, k + 1 if (k := next((k for k, o in enumerate(order) if o is r), cut)) < cut else None)) for r in rows)


def result(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"])) for r in df.collect())


def test_fixture_against_plain(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(0, r.text) for r in target.collect()])
    assert result(x.resample(docs, target)) == want


def test_awkward_rows(spark, awkward):
    target = spark.createDataFrame([("the cat sat",), (None,), ("",)], "text string")
    for options in ({}, {"percent": 100, "least": 0}, {"percent": 50, "least": 1, "widest": 3, "buckets": 97, "seed": 1}):
        want = plain([(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()], [(0, "the cat sat")], **options)
        named = {"least_words" if k == "least" else k: v for k, v in options.items()}
        got = x.resample(awkward, target, **named)
        assert result(got) == want
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    kept = x.drawn(awkward, target, percent=50, least_words=1)
    assert kept.columns == awkward.columns and kept.count() == awkward.where("text rlike '[a-zA-Z0-9À-ÿ]'").count() * 50 // 100


def test_empty_tables(spark, awkward, empty):
    none = spark.createDataFrame([], "text string")
    assert x.resample(empty, none).count() == 0 == x.drawn(empty, none).count()
    rows = x.resample(awkward, none).collect()
    assert len(rows) == awkward.count() and all(r.weight == 0 for r in rows if r.n_words == 0)


def test_result_is_the_same_however_rows_are_dealt(spark, sf):
    docs, target = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    twice = docs.union(docs.where("doc_id % 3 = 0")).select("doc_id", "text")
    assert result(x.resample(twice, target)) == result(x.resample(twice.repartition(7, F.col("text")), target))


def test_crc_of_joined_texts():
    rng = np.random.default_rng(1)
    for _ in range(100):
        a, b = (rng.integers(0, 256, rng.integers(0, 300)).astype(np.uint8).tobytes() for _ in range(2))
        got = x.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([len(b)]))
        assert got[0] == zlib.crc32(a + b)


def test_pieces_of_long_texts(monkeypatch):
    """Cut between words, wherever the pieces end."""
    monkeypatch.setattr(x, "PIECE", 7)
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = "".join(rng.choice(list("aÉ9 .\n日Z"), rng.integers(0, 60)))
        words = x.Words()
        ids, pairs = words.of(text.encode())
        names, raw = list(words.number), text.translate(str.maketrans(UPPER, LOWER)).encode()
        assert [names[i] for i in ids] == WORDS.findall(raw.decode()) == [raw[a:b].decode() for a, b in pairs]
