from collections import defaultdict

from pyspark.sql import functions as F

from tapeline.llm import exact_dedup as x


def fold(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[fold(t)].append(i)
    return sorted((i, max(groups[fold(t)]), len(groups[fold(t)])) for i, t in rows)


def test_matches_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = x.exact_dedup(docs).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == brute([tuple(r) for r in docs.collect()])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_colliding_digests_are_told_apart_by_bytes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    weak = x.exact_dedup(docs, digest=lambda t: F.md5((F.length(t) % 3).cast("string")))
    assert sorted(map(tuple, weak.collect())) == sorted(map(tuple, x.exact_dedup(docs).collect()))


def test_awkward_rows(awkward):
    got = x.exact_dedup(awkward).collect()
    assert len(got) == awkward.count()
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].keep_id == 2 and by_id[1].group_size == 3
    assert by_id[3].keep_id == 4 and by_id[4].kept  # null is empty
    assert by_id[9].kept and by_id[10].kept  # only A-Z is folded
    kept = x.drop_duplicates(awkward)
    assert kept.columns == awkward.columns and kept.count() == sum(r.kept for r in got) == 9


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sum(r.kept for r in x.exact_dedup(docs).collect()) == 1 == x.drop_duplicates(docs).count()


def test_empty(empty):
    assert x.exact_dedup(empty).count() == 0 == x.drop_duplicates(empty).count()


def test_state_continues(spark, tmp_path):
    folder, checkpoint = f"file://{tmp_path}/prints", f"file://{tmp_path}/checkpoint"
    prints = lambda rows: spark.createDataFrame(rows, "doc_id long, place struct<file:bigint,row:bigint>, digest string").coalesce(1)
    first = prints([(1, (0, 0), "d"), (2, (0, 1), "e")])
    first.write.parquet(folder)
    x.remember(spark, folder, first.schema, checkpoint)
    prints([(7, (1, 0), "d")]).write.mode("append").parquet(folder)
    state = {r.digest: (r.keeper.doc_id, r.n) for r in x.remember(spark, folder, first.schema, checkpoint).collect()}
    assert state == {"d": (7, 2), "e": (2, 1)}
