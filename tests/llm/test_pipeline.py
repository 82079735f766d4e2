import math

import pytest
from test_exact_dedup import brute as equal_groups
from test_mixing import wanted
from test_near_dedup import brute as components
from test_packing import check as check_packing

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp(name)}/out"
        stage(spark, docs, sf).write.parquet(path)
        made = spark.read.parquet(path)
        out.append((name, docs, made))
        docs = made
    return out


def test_order_and_columns(stages):
    assert [name for name, _, _ in stages] == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language_keeps_clean_documents(stages):
    _, before, after = stages[0]
    gone = before.join(after, "doc_id", "left_anti").collect()
    assert all(len(r.text.split()) < 4 or not any(map(str.isalpha, r.text)) for r in gone)


def test_duplicates(stages):
    _, before, after = stages[1]
    want = {keep for _, keep, _ in equal_groups([(r.doc_id, r.text) for r in before.collect()])}
    assert sorted(r.doc_id for r in after.collect()) == sorted(want)
    _, before, after = stages[2]
    found = components([(r.doc_id, r.text) for r in before.collect()], width=5, percent=80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(found.values()))


def test_mixing(stages):
    _, before, after = stages[3]
    size = lambda t: len([w for w in t.split() if w])
    sizes, taken, counts = {}, {}, {}
    for r in before.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for r in after.collect():
        taken[r.source] = taken.get(r.source, 0) + size(r.text)
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    target = wanted(sizes)
    assert max(counts.values()) <= 2
    assert all(math.isclose(taken.get(s, 0), target[s], rel_tol=0.05, abs_tol=20) for s in sizes)


def test_packing(stages):
    _, before, after = stages[4]
    once = {r.doc_id for r in before.groupBy("doc_id").count().where("count = 1").collect()}
    rows = after.collect()
    texts = {r.doc_id: r.text for r in before.collect() if r.doc_id in once}
    check_packing(rows, texts)
    assert sum(r.piece == 0 for r in rows) == before.count()


def test_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1][2].count()


def chained(spark, docs, folder):
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, docs, None).write.parquet(path)
        docs = spark.read.parquet(path)
        sizes.append((name, docs.count(), docs.columns))
    return docs, sizes


def test_awkward_rows_pass_through_every_stage(spark, sf, awkward, tmp_path):
    """Nulls in every column, empty, blank and very long texts, repeated rows, shared ids and clashing names, beside documents
    of the fixture that the language stage can learn from."""
    names = [c for c in awkward.columns if c not in ("doc_id", "text", "lang", "source", "a.b", "_metadata")]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source")
    odd = awkward.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame([(None, None, None, None)] * 2, "doc_id long, text string, lang string, source string"))
    rows = docs.unionByName(odd).unionByName(odd).selectExpr("*", *(f"'x' AS `{c}`" for c in names))
    out, sizes = chained(spark, rows, tmp_path)
    kept = {name: n for name, n, _ in sizes}
    assert all(columns == rows.columns for name, _, columns in sizes[:-1]) and "sequence_id" in out.columns
    assert rows.count() > kept["language_id"] > kept["exact_dedup"] >= kept["near_dedup"] > 100
    once = spark.read.parquet(f"file://{tmp_path}/near_dedup")
    assert once.where("text is null or trim(text) = ''").count() == 0  # no language
    assert once.where("length(text) > 100000").count() <= 1 and once.where("lower(text) like 'the cat sat%'").count() == 1


def test_an_empty_table_passes_through_every_stage(spark, empty, tmp_path):
    out, sizes = chained(spark, empty.select("doc_id", "text", "lang", "source"), tmp_path)
    assert [n for _, n, _ in sizes] == [0] * 5 and out.count() == 0
