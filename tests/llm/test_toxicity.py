import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tapeline.llm import texts
from tapeline.llm import toxicity as x


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_ranking(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = x.score_toxicity(spark.read.parquet(f"{d}/documents.parquet"), labels).collect()
    mark = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in mark]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    y, s = np.array([mark[r.doc_id] for r in held]), np.array([r.score for r in held])
    assert auc(y, s) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert ((s >= 0.5) & (y == 0)).sum() < 0.03 * (y == 0).sum()


def test_probabilities_of_a_stem_add_up():
    rng = np.random.default_rng(0)
    size = 1 << x.PART_BITS
    stems, words = np.zeros((2, size)), np.zeros((2, 1 << x.WORD_BITS))
    counts = rng.integers(0, 40, (2, 50))  # one stem with 50 words
    stems[:, 3], words[:, :50] = counts.sum(1), counts
    freed, follows = np.zeros((2, size)), np.zeros(size)
    freed[:, 3], follows[:50] = np.minimum(counts, 4.0).sum(1), 1
    model = x.Model(words, stems, freed, np.zeros(size), follows, (4.0, 4.0))
    for k in (0, 1):
        total = model.words[k, :50].sum() / model.stems[k, 3] + model.free[k, 3] * model.shared_rest.sum()
        assert abs(total - 1) < 0.02


def test_awkward_rows(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    rows = x.score_toxicity(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(0 <= r.score <= 1 for r in rows) and next(r for r in rows if r.doc_id is None).held_out
    assert x.score_toxicity(empty, labels).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    spoiled = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) AS toxic")
    assert sorted(map(tuple, x.score_toxicity(docs, labels).collect())) == sorted(map(tuple, x.score_toxicity(docs, spoiled).collect()))


def plain_gap(rows):
    """log P(word | toxic) - log P(word | ordinary) for all words of `rows` (text, toxic), from Python's dictionaries."""
    counts = [Counter(), Counter()]
    for text, toxic in rows:
        counts[toxic].update(re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower()))
    vocabulary, size = set(counts[0]) | set(counts[1]), 1 << x.PART_BITS
    kinds = {w: (w[:4], w[4:]) for w in vocabulary}
    after, before = Counter(s for s, _ in kinds.values()), Counter(r for _, r in kinds.values())
    probability = []
    for c in counts:
        once, twice = (sum(v == n for v in c.values()) for n in (1, 2))
        d = once / (once + 2 * twice) if once + twice else 0.5
        stems, freed = Counter(), Counter()
        for w, n in c.items():
            stems[kinds[w][0]] += n
            freed[kinds[w][0]] += min(n, d)
        total, spare = sum(stems.values()), sum(min(n, d) for n in stems.values())

        def of(w, c=c, d=d, stems=stems, freed=freed, total=total, spare=spare):
            s, r = kinds[w]
            stem = (max(stems[s] - d, 0) + (spare + 0.5) * (after[s] + 0.5) / (len(vocabulary) + 0.5 * size)) / (total + 0.5)
            rest = max(c[w] - d, 0) + (freed[s] + 0.5) * (before[r] + 0.5) / (len(vocabulary) + 0.5 * size)
            return math.log(stem) + math.log(rest / (stems[s] + 0.5))

        probability.append(of)
    return {w: probability[1](w) - probability[0](w) for w in vocabulary}


def test_models_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    words = [a + b for a in ("mall", "Sten", "vörd", "ki", "orra") for b in ("", "a", "ende", "ingar", "x9", "ster")]
    rows = []
    for i in range(300):
        toxic = int(rng.random() < 0.4)
        at = np.minimum(rng.geometric(0.12 if toxic else 0.2, 6) - 1, len(words) - 1)
        rows.append((i, ", ".join([words[k if toxic else -1 - k] for k in at] + ([f"solo{i}"] if i % 3 else [f"pair{i // 6}"])), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = x.fit(docs, labels)  # fits the curve on all rows of remainder 1
    want = plain_gap([(t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 5 > 1])
    assert len(want) > 100
    chunk = next(iter(texts.chunks(pa.array([" ".join(w.decode() for w in want)]))))
    stem, rest, word, _ = x._parts(chunk)
    assert np.allclose(model.gaps(stem, rest, word), list(want.values()), atol=1e-3)
