import math

import pytest
from pyspark.sql import functions as F

from tapeline.llm import mixing as x


def wanted(sizes, share=1.5, most=2.0):
    """Targets by sharing the excess out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: x.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, full, left = {}, set(), share * sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = left - sum(most * sizes[s] for s in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / sum(weight[t] for t in open_) for s in names}
        over = {s for s in open_ if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows, sources, slack):
    sizes = {}
    for r in rows:
        s = sources[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
    target = wanted(sizes)
    for s in sizes:
        mine = [r for r in rows if sources[r.doc_id] == s]
        assert all(math.isclose(r.target, target[s], rel_tol=1e-9, abs_tol=1e-6) and r.source_size == sizes[s] for r in mine)
        # Whole documents are taken: tiny blocks may hold just one.
        assert abs(sum(r.taken for r in mine) - target[s]) <= max(slack * target[s], (slack > 0.05) * max(r.size for r in mine) / 2)
    assert all(r.taken <= 2 * r.size for r in rows)


@pytest.mark.parametrize("options,slack", [({}, 0.02), ({"block_words": 500, "shard_words": 2000}, 0.06)])
def test_targets_are_met(spark, sf, options, slack):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = x.mix_summary(docs, **options).collect()
    sources = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    check(rows, sources, slack)
    again = x.mix_summary(docs.repartition(3), **options).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_has_the_rows_that_the_summary_counts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    taken = {r.doc_id: r.taken // max(1, r.size) for r in x.mix_summary(docs).collect()}
    rows = x.mix(docs)
    assert rows.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    assert counts == {k: v for k, v in taken.items() if v}


def test_tree_keeps_quotas_and_halves(spark):
    quotas = spark.createDataFrame([(1, 1000), (2, 10), (3, 0), (4, 37)], "source_no int, quota long")
    rows = x.split_tree(quotas, 3).collect()
    assert {s: sum(r.quota for r in rows if r.source_no == s) for s in (1, 2, 3, 4)} == {1: 1000, 2: 10, 3: 0, 4: 37}
    totals = [sum(r.quota for r in rows if r.shard == k) for k in range(8)]
    assert max(totals) - min(totals) <= 1 and all(r.quota >= 0 for r in rows)


def test_hypergeometric_moments(spark):
    n, good, bad, draws = 4000, 300.0, 700.0, 200.0
    u = (F.col("id") + 0.5) / n
    row = spark.range(n).select(x.hypergeometric(F.lit(good), F.lit(bad), F.lit(draws), u).alias("g")).agg(F.mean("g"), F.var_pop("g")).first()
    mean = draws * good / (good + bad)
    assert abs(row[0] - mean) < 0.05 and abs(row[1] - mean * 0.7 * 800 / 999) < 1


def test_awkward_rows(awkward):
    rows = x.mix_summary(awkward).collect()
    assert len(rows) == awkward.count() and all(r.taken == 0 for r in rows if r.size == 0)
    assert next(r for r in rows if r.doc_id == 7).size == 30_000
    assert x.mix(awkward).columns == awkward.columns


def test_empty(empty):
    assert x.mix_summary(empty).count() == 0 == x.mix(empty).count()


def test_rows_that_share_their_doc_id_are_spread(spark):
    # 30,000 rows without words, 3,000 different texts without a doc_id, 500 equal rows.
    docs = spark.range(30_000).selectExpr("id AS doc_id", "' ' AS text", "'a' AS source").unionAll(
        spark.range(3_000).selectExpr("CAST(NULL AS BIGINT)", "concat(repeat('w ', 19), id)", "'a'")
    ).unionAll(spark.range(500).selectExpr("7", "repeat('v ', 10)", "'b'"))
    made = x.Mix(docs, block_words=2_000)
    placed = made.placed.where("source = 'a' AND size > 0").groupBy("block").count().collect()
    assert len(placed) == 30 and max(r["count"] for r in placed) < 250
    assert made.parts.count() <= 200
    got = {r.source_size: (r.taken, r.target, r.n) for r in x.mix_summary(docs, block_words=2_000).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.count("*").alias("n")).collect()}
    taken, target, n = got[60_000]
    assert n == 33_000 and abs(taken - target) <= 20
    assert abs(got[5_000][0] - got[5_000][1]) <= 10 and got[5_000][2] == 500  # equal rows are drawn each by itself
    assert x.mix(docs, block_words=2_000).count() == sum(r.taken // r.size for r in x.mix_summary(docs, block_words=2_000).where("size > 0").collect())


def test_rows_with_one_doc_id_and_different_sizes_are_judged_apart(spark):
    docs = spark.createDataFrame([(1, "x " * k, s) for s in ("a", "b") for k in (3, 30, 300)], "doc_id long, text string, source string")
    rows = x.mix_summary(docs).collect()
    assert len(rows) == 6 and len({(r.source_size, r.size) for r in rows}) == 3
    for r in rows:
        assert r.taken % r.size == 0 and r.taken <= 2 * r.size
    total = sum(r.taken for r in rows)
    assert abs(total - 1.5 * 666) < 40


def test_a_source_of_one_row_again_and_again_meets_its_target(spark):
    docs = spark.range(500).selectExpr("7 AS doc_id", "repeat('v ', 10) AS text", "'b' AS source").unionAll(spark.range(200).selectExpr("id", "concat(repeat('w ', 9), id)", "'a'"))
    rows = x.mix_summary(docs).where("source_size = 5000").collect()
    assert len(rows) == 500 and abs(sum(r.taken for r in rows) - rows[0].target) <= 10 and {r.taken for r in rows} <= {0, 10, 20}
    again = x.mix_summary(docs.repartition(5, "doc_id", F.rand(1))).where("source_size = 5000").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    drawn = x.mix(docs).where("source = 'b'").count()
    assert drawn == sum(r.taken for r in rows) // 10


def test_many_equal_rows_are_joined(spark, monkeypatch):
    docs = spark.range(300).selectExpr("7 AS doc_id", "repeat('v ', 10) AS text", "'b' AS source")
    want = x.mix(docs).count()
    monkeypatch.setattr(x, "FEW", 3)
    assert x.mix(docs).count() == want == 450
