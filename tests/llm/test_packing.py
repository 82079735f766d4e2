import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tapeline.llm import packing as x

tokenizers = pytest.importorskip("tokenizers")


def check(rows, texts):
    exact = tokenizers.Tokenizer.from_file(x.default_vocabulary())
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    for i, text in texts.items():
        ids = np.array(exact.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert [p.start for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1]] and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 2048 for p in parts[1:]) and len(parts) == -(-len(ids) // 2048)
        assert all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in parts)
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(sequences)


@pytest.mark.parametrize("group_items", [20_000, 40])
def test_pieces_and_places(spark, sf, group_items):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = x.pack(docs, group_items=group_items).collect()
    n = check(rows, {r.doc_id: r.text for r in docs.collect()})
    least = -(-sum(r.length for r in rows) // 2048)
    assert n <= least + 2


def test_awkward_rows(awkward):
    rows = x.pack(awkward.where("doc_id is null or doc_id <> 1")).collect()
    texts = {r.doc_id: r.text for r in awkward.select("doc_id", "text").collect() if r.doc_id != 1}
    check(rows, texts)
    twice = x.pack(awkward.where("doc_id = 1")).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_empty(empty):
    assert x.pack(empty).count() == 0


def test_encoder_on_unusual_text():
    exact = tokenizers.Tokenizer.from_file(x.default_vocabulary())
    with open(x.default_vocabulary(), encoding="utf-8") as f:
        encode = x.Encoder(f.read())
    rng = random.Random(3)
    parts = ["don't", " ", "\n", "  ", "é", "½", "²", "日本", "\xa0", "\x1c", "<|endoftext|>", "ABC", "12", "Ⅷ", "_", "'ll", "\t", "　", "😀", "."]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert np.frombuffer(encode(text), "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, text


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= capacity:
                bins[k] += sizes[i]
                place(i + 1, bins)
                bins[k] -= sizes[i]
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


def test_bounds_never_exceed_the_optimum():
    rng = random.Random(1)
    for _ in range(300):
        sizes = np.array([rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))])
        best = optimum(sorted(sizes.tolist(), reverse=True), 20)
        bins, offsets, n = x.best_fit_decreasing(sizes, 20)
        assert x.lower_bound(sizes, 20) <= best <= n
        assert np.bincount(bins, weights=sizes).max() <= 20
