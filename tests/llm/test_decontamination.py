import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeline.llm import decontamination as x
from tapeline.llm.common import LOWER, UPPER

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def cut(text):
    return WORDS.findall((text or "").translate(str.maketrans(UPPER, LOWER)))


def plain(docs, items, width=10):
    """Every window at every place."""
    windows = {}
    for i, text in items:
        w = cut(text)
        size = min(width, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    rows = []
    for i, text in docs:
        w, hit, found = cut(text), set(), set()
        for size in {len(k) for k in windows}:
            for at in range(len(w) - size + 1):
                if (got := windows.get(tuple(w[at : at + size]))) is not None:
                    hit |= set(range(at, at + size))
                    found |= got
        names = sorted(str(k) for k in found if k is not None)
        rows.append(repr((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))))
    return sorted(rows)


def result(df):
    return sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in df.collect())


def test_fixture_against_plain(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert any("True" in r for r in want) and result(x.decontaminate(docs, items)) == want


@pytest.mark.parametrize("width,shingle", [(10, 3), (4, 2), (2, 3), (1, 1), (6, 6)])
def test_few_words_many_overlaps(spark, width, shingle):
    """Three words only, so that windows overlap, repeat and share shingles; items short, repeated, null and empty."""
    rng = np.random.default_rng(width)
    words = lambda n: " ".join(rng.choice(["a", "B", "cé"], n))
    docs = [(i, words(rng.integers(0, 60))) for i in range(60)] + [(1, "b"), (None, words(40)), (7, None), (8, ""), (9, " .. ")]
    items = [(i, words(rng.integers(1, 14))) for i in range(6)] + [(100, "a b a b a b a b a b a b"), (101, "A b a b, a b a b a b a b"), (100, "cé cé"), (102, None), (103, "!"), (None, "b b b b")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert result(x.decontaminate(d, b, width, shingle)) == plain(docs, items, width)


def test_awkward_rows(spark, awkward, empty):
    items = spark.createDataFrame([(5, "on THE mat, with the other"), (11, "word"), (12, "nowhere at all")], "item_id long, text string").withColumn("window", F.lit("x")).withColumn("words", F.lit(1))
    docs = [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    got = x.decontaminate(awkward, items)
    assert result(got) == plain(docs, [(5, "on THE mat, with the other"), (11, "word"), (12, "nowhere at all")])
    assert {tuple(r["items"]) for r in got.collect()} == {(), ("5",), ("11",)}
    kept = x.drop_contaminated(awkward, items)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    assert x.decontaminate(empty, items).count() == 0 == x.drop_contaminated(empty, items).count()
    assert not any(r.contaminated for r in x.decontaminate(awkward, items.limit(0)).collect())


def test_bitmap_that_lets_everything_through(spark, sf, monkeypatch):
    """A full bitmap costs time, not correctness."""
    monkeypatch.setattr(x, "BITS", 64)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    docs = docs.where("length(text) < 2000")
    want = plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert result(x.decontaminate(docs, items)) == want


def test_rarest_shingle_is_the_prefix(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c x"), (3, "b c d x")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e"), (2, "x y z")], "item_id long, text string")
    rows = x.prefixes(x.item_windows(items)[0], docs).collect()
    assert [(r.words, r["shift"]) for r in rows] == [(["a", "b", "c", "d", "e"], 2)]  # `c d e` stands once; `x y z` nowhere
