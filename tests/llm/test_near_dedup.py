import random
import re

from tapeline.llm import near_dedup as x


def sets(text, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute(rows, width=3, percent=85):
    """Component of each doc_id by comparing all pairs."""
    s = {i: sets(t, width) for i, t in rows if i is not None}
    parent = {i: i for i in s}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(s)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(s[a] & s[b])
            if s[a] and s[b] and 100 * both >= percent * (len(s[a]) + len(s[b]) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in s}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"w{rng.randrange(10**6)}"
    return " ".join(out)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    got = x.near_dedup(docs).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_dense_group_and_shared_passage(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    passage = " ".join(f"p{i}" for i in range(120))
    rows = [(i, edited(rng, base, rng.randrange(0, 8))) for i in range(150)]
    rows += [(1000 + i, passage + " " + " ".join(f"u{i}x{j}" for j in range(60))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in x.near_dedup(docs, small=8, levels=2).collect()}
    assert got == brute(rows)


def test_awkward_rows(awkward):
    got = x.near_dedup(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].component_id == 1 and not by_id[2].kept and by_id[1].kept
    assert by_id[3].n_shingles == by_id[4].n_shingles == by_id[5].n_shingles == 0 and by_id[3].kept and by_id[5].component_id == 5
    assert by_id[7].n_shingles == 1 and by_id[8].n_shingles == 1
    assert by_id[None].kept and by_id[None].component_id is None
    kept = x.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted({r.doc_id or -1 for r in got if r.kept})


def test_empty(empty):
    assert x.near_dedup(empty).count() == 0 == x.drop_near_duplicates(empty).count()


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    labels = {r.v: r.label for r in x.components(edges).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[101] == 100


def bridged(k):
    """Two groups of copies that are linked by one pair only, all of whose common shingles many members have."""
    spots = range(10, 100, 10)
    mixed = lambda second: [f"y{k}x{j}" if j in second else f"x{k}x{j}" if j in spots else f"b{k}x{j}" for j in range(200)]
    rows = [mixed(spots[:3]), mixed(spots[:6]), *(mixed(second) for second in ((), spots) for _ in range(60))]
    for i, words in enumerate(rows):
        words[140 + i % 50] = f"e{k}x{i}"
    return [(k * 1000 + (i * 37 + 5) % 499, " ".join(words)) for i, words in enumerate(rows)]


def parted(docs, rows, got, trees):
    """Linked pairs that share a node of level 0 but not a component."""
    tokens = {r.doc_id: r.tokens[:trees] for r in x.signatures(docs).collect()}
    s = {i: sets(t) for i, t in rows}
    return [
        (a, b) for a in s for b in s
        if a < b and got[a] != got[b] and any(p == q for p, q in zip(tokens[a], tokens[b], strict=True))
        and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b])
    ]


def test_linked_members_of_a_large_last_node_are_compared(spark):
    rows = [row for k in range(4) for row in bridged(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in x.near_dedup(docs, levels=0, trees=2).collect()}
    assert not parted(docs, rows, got, 2)


def clustered(k):
    """Two groups of 60 copies with a similarity of about 0.7, joined by one pair at 0.86; none of its ends is a copy of a pivot's."""
    rng = random.Random(k)
    x, y = [f"x{k}x{i}" for i in range(200)], [f"x{k}x{i}" for i in range(200)]
    for i in range(0, 60, 6):
        y[i] = f"y{k}x{i}"
    middle = [b if i < 30 else a for i, (a, b) in enumerate(zip(x, y, strict=True))]
    rows = [edited(rng, x, 3) for _ in range(60)] + [edited(rng, y, 3) for _ in range(60)] + [" ".join(middle)]
    ids = rng.sample(range(500), len(rows))
    return [(k * 1000 + i, text) for i, text in zip(ids, rows, strict=True)]


def test_clusters_joined_by_few_pairs(spark):
    rows = [row for k in range(6) for row in clustered(k)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in x.near_dedup(docs, minority=8).collect()}
    assert got == brute(rows)


def test_width_and_limit(spark):
    words = [f"w{i}" for i in range(100)]
    close = [*words[:50], "new", *words[51:]]  # 91 of 101 shingles of five words are common
    apart = [*words[:20], "p", *words[21:50], "q", *words[51:80], "r", *words[81:]]  # 81 of 111
    rows = [(1, " ".join(words)), (2, " ".join(close)), (3, " ".join(apart)), (4, "one two three"), (5, "one two  three"), (6, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in x.near_dedup(docs, width=5, percent=80).collect()}
    assert got == {1: (96, 1), 2: (96, 1), 3: (96, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6)}


def test_rows_that_share_an_id_stay_apart(spark):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"v{i}" for i in range(50))
    docs = spark.createDataFrame([(1, text), (1, text), (2, other), (2, None), (3, other)], "doc_id long, text string")
    kept = sorted((r.doc_id, r.text or "") for r in x.drop_near_duplicates(docs).collect())
    assert kept == [(1, text), (2, ""), (2, other)]
