import math
import zlib

import numpy as np

from tapeline.llm import langid as x


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = x.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in langs if zlib.crc32(str(i).encode()) % 3 == 1}
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    spoiled = docs.selectExpr("doc_id", "text", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 'xx', lang) AS lang", "source")
    assert sorted(map(tuple, x.identify(docs).collect())) == sorted(map(tuple, x.identify(spoiled).collect()))


def test_codewords():
    for k in (2, 3, 4, 6, 7, 20):
        code = x.codewords(k).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
        assert code.shape[0] == k and min(apart) >= (1 if k == 2 else 2)
        assert (np.abs(code.sum(0)) < k).all()


def test_awkward_rows(awkward):
    rows = {r.doc_id: r for r in x.identify(awkward).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (3, 4, 5, 8))
    assert rows[9].lang_pred != "und" and rows[None].held_out
    kept = x.drop_unidentified(awkward)
    assert kept.columns == awkward.columns and not {3, 4, 5, 8} & {r.doc_id for r in kept.select("doc_id").collect()}


def test_rows_that_share_an_id_are_judged_apart(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    twice = docs.union(spark.createDataFrame([(0, "12 34", None), (None, "!!", None)], "doc_id long, text string, lang string"))
    kept = x.drop_unidentified(twice).collect()
    assert any(r.doc_id == 0 for r in kept) and not {"12 34", "!!"} & {r.text for r in kept}


def test_empty_and_unlabelled(awkward, empty):
    assert x.identify(empty).count() == 0 == x.drop_unidentified(empty).count()
    assert {r.lang_pred for r in x.identify(awkward.selectExpr("doc_id", "text", "cast(null as string) AS lang")).collect()} == {"und"}


def plain_trigrams(text):
    """Counts of hashed trigrams, one character after the other."""
    fold = [c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in text.encode()]
    out = {}
    for a, b, c in zip(fold, fold[1:], fold[2:], strict=False):
        if not (a == b == 32 or b == c == 32):
            h = ((a * 0x9E3779B1 ^ b * 0x85EBCA77 ^ c * 0xC2B2AE3D) & 0xFFFFFFFF) * 0x27D4EB2F & 0xFFFFFFFF
            if k := h >> (32 - x.BITS):
                out[k] = out.get(k, 0) + 1
    return out


def plain(rows):
    """The method in plain Python: rows of (doc_id, text, lang) to doc_id -> (lang_pred, score)."""
    learned = [(t, lang) for i, t, lang in rows if lang is not None and zlib.crc32(str(i).encode()) % 3 != 1]
    langs, size = sorted({lang for _, lang in learned}), 1 << x.BITS
    # All splits of the languages but that into all and none, the first language always a 1.
    splits = [[True] + [bool(c >> k & 1) for k in range(len(langs) - 1)] for c in range(2 ** (len(langs) - 1) - 1)]
    counts = {lang: [0.5] * size for lang in langs}
    for t, lang in learned:
        for k, n in plain_trigrams(t or "").items():
            counts[lang][k] += n
    share = {lang: (sum(c), c) for lang, c in counts.items()}
    at = lambda lang, k: share[lang][1][k] / share[lang][0]
    weights = []
    for split in splits:
        ones, zeros = ([lang for lang, s in zip(langs, split, strict=True) if s == side] for side in (True, False))
        weights.append([math.log(sum(at(lang, k) for lang in ones) / len(ones)) - math.log(sum(at(lang, k) for lang in zeros) / len(zeros)) for k in range(size)])

    def margins(t):
        got = plain_trigrams(t)
        n = sum(got.values())
        return [sum(c * w[k] for k, c in got.items()) * min(1, x.EVIDENCE / n) / 4 if n else 0.0 for w in weights]

    trust = []
    seen = [(margins(t or ""), lang) for t, lang in learned]
    for b, split in enumerate(splits):
        hits = sum(m[b] * (1 if split[langs.index(lang)] else -1) > 0 for m, lang in seen)
        rate = (hits + 1) / (len(seen) + 2)
        trust.append(max(0.05, math.log(rate / (1 - rate))))
    out = {}
    for i, t, _ in rows:
        if not any(map(str.isalpha, t or "")):
            out[i] = ("und", 0.0)
            continue
        m = margins(t)
        loss = []
        for j in range(len(langs)):
            each = [w * math.log1p(math.exp(-min(700, max(-700, v * (1 if s[j] else -1))))) for w, v, s in zip(trust, m, splits, strict=True)]
            loss.append(sum(each) / sum(trust) * math.sqrt(len(splits)))
        best = min(range(len(langs)), key=loss.__getitem__)  # of equal losses the first language
        out[i] = langs[best], 1 / sum(math.exp(loss[best] - v) for v in loss)
    return out


def test_weights_and_decoding_match_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang) for r in docs.collect()]
    want = plain(rows)
    for r in x.identify(docs).collect():
        lang, score = want[r.doc_id]
        assert r.lang_pred == lang and abs(r.score - score) < 1e-3
