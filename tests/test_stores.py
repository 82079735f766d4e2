import os
import random

import pytest
from pyspark.sql import functions as F

from tapeline.operators import links
from tapeline.sinks.files import OutsideRoot, write_files
from tapeline.stores import Store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """A folder by a path that only Spark opens, and its local name."""
    local = tmp_path_factory.mktemp("store")
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.tape.link./w", f"file://{local}")
    return "viewfs://tape/w", local


def texts(folder):
    return {os.path.relpath(f"{d}/{f}", folder): open(f"{d}/{f}", newline="", encoding="utf-8").read() for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc")}


def test_files_named_by_rows(spark, store):
    root, local = store
    rows = [("/x/a b+%41é.md", "é\nl2\n"), ("x/../y/b=1.md", "no end"), ("z.md", None), ("/x/a b+%41é.md", "b\r\n"), ("q/c.md", "\n"), ("q/d.md", "a\n\n"), ("q/long" + "g" * 200 + ".md", "w " * 100_000 + "\n"), (None, "x")]
    docs = spark.createDataFrame(rows, "output_path string, content string")
    assert write_files(docs, f"{root}/o u%20t") == 6
    want = {"x/a b+%41é.md": "é\nl2\n", "y/b=1.md": "no end\n", "z.md": "\n", "q/c.md": "\n", "q/d.md": "a\n\n", "q/long" + "g" * 200 + ".md": "w " * 100_000 + "\n"}
    assert texts(local / "o u%20t") == want
    assert write_files(docs.where("output_path = 'z.md'").withColumn("content", F.lit("new")), f"{root}/o u%20t") == 1
    assert texts(local / "o u%20t") == want | {"z.md": "new\n"}
    assert write_files(docs.limit(0), f"{root}/none") == 0 and texts(local / "none") == {}


def test_files_on_disks_are_made_and_placed_by_tasks(spark, store, tmp_path, monkeypatch):
    """As on other stores, and the driver renames none; checksums of files that are replaced go."""
    root, local = store
    names = ["/x/a b+%41é.md", "x/../y/b=1.md", "z.md", "q/long" + "g" * 200 + ".md", *(f"n/{i}.md" for i in range(300))]
    docs = spark.createDataFrame([*((n, f"{n}\r\né\n" * (i % 3)) for i, n in enumerate(names)), (None, "x")], "output_path string, content string")
    assert write_files(docs, f"{root}/both") == len(names)
    elsewhere = texts(local / "both")
    assert os.path.exists(local / "both/n/.7.md.crc")

    def refused(*_):
        raise AssertionError("the driver renames files")

    for f in ("move", "move_only"):
        monkeypatch.setattr(Store, f, refused, raising=False)
    assert write_files(docs, f"file://{tmp_path}/o u%20t") == len(names) and texts(tmp_path / "o u%20t") == elsewhere
    assert os.listdir(tmp_path / "o u%20t/y") == ["b=1.md"] and "_staging" not in " ".join(os.listdir(tmp_path / "o u%20t"))
    changed = docs.where("output_path like 'n/%'").withColumn("content", F.lit("other\n"))
    assert write_files(changed, str(local / "both")) == 300
    assert texts(local / "both") == {k: "other\n" if k.startswith("n/") else v for k, v in elsewhere.items()}
    assert {r.value for r in spark.read.text(f"{root}/both/n", wholetext=True).collect()} == {"other\n"}
    with pytest.raises(OutsideRoot):
        write_files(docs.unionByName(spark.createDataFrame([("../x.md", "y")], docs.schema)), f"file://{tmp_path}/safe")
    assert texts(tmp_path / "safe") == {}


def test_plain_renames_where_they_do(spark, store, monkeypatch):
    """Other stores: no file that Spark lists, no rename that asks for links; a folder in the way stays."""
    root, local = store
    docs = spark.createDataFrame([(f"n/{i}.md", str(i)) for i in range(20)], "output_path string, content string")
    monkeypatch.setattr(Store, "move", lambda *_: pytest.fail("a plain rename would do"))
    assert write_files(docs, f"{root}/plain") == 20
    monkeypatch.undo()
    assert write_files(docs.withColumn("content", F.lit("new")), f"{root}/plain") == 20  # over those that are there
    assert set(texts(local / "plain").values()) == {"new\n"}
    os.makedirs(local / "plain/n/folder.md")
    with pytest.raises(Exception, match="must both be directories"):
        write_files(spark.createDataFrame([("n/folder.md", "y")], docs.schema), f"{root}/plain")
    assert os.listdir(local / "plain/n/folder.md") == [] and len(texts(local / "plain")) == 20


@pytest.mark.parametrize("path", ["../x.md", "a/../../x.md", "/", ".", ""])
def test_files_stay_below_their_root(spark, store, path):
    root, local = store
    with pytest.raises(OutsideRoot):
        write_files(spark.createDataFrame([("ok.md", "y"), (path, "y")], "output_path string, content string"), f"{root}/safe")
    assert texts(local / "safe") == {}


def test_a_failed_job_leaves_nothing(spark, store):
    root, local = store
    docs = spark.createDataFrame([("a.md", "old")], "output_path string, content string")
    write_files(docs, f"{root}/kept")
    with pytest.raises(Exception, match="spoiled"):
        write_files(docs.withColumn("content", F.concat("content", F.raise_error(F.lit("spoiled")).cast("string"))), f"{root}/kept")
    assert texts(local / "kept") == {"a.md": "old\n"} and [x for x in os.listdir(local / "kept") if not x.endswith(".crc")] == ["a.md"]


def followed(path, table):
    """One name after the other, as file systems do it; None in a circle."""
    done, rest, hops = [], [x for x in path.split("/") if x not in ("", ".")], 0
    while rest:
        x = rest.pop(0)
        if x == "..":
            done = done[:-1]
        elif (link := "/" + "/".join([*done, x])) in table:
            hops += 1
            if hops > 300:
                return None
            done = [] if table[link].startswith("/") else done
            rest = [y for y in table[link].split("/") if y not in ("", ".")] + rest
        else:
            done.append(x)
    return "/" + "/".join(done)


def test_links_against_the_file_system(spark, tmp_path):
    rng = random.Random(5)
    top = os.path.realpath(tmp_path)
    folders, table = [top], {}
    for i in range(8):
        folders.append(f"{rng.choice(folders)}/d{i}")
        os.mkdir(folders[-1])
    for i in range(14):
        at = rng.choice(folders)
        to = rng.choice([rng.choice(folders), f"l{rng.randrange(14)}", f"../l{rng.randrange(14)}", os.path.relpath(rng.choice(folders), at), f"{rng.choice(folders)}/l{rng.randrange(14)}", f"d{rng.randrange(8)}/../l{rng.randrange(14)}"])
        os.symlink(to, f"{at}/l{i}")
        table[f"{at}/l{i}"] = to
    asked = [f"{rng.choice(folders)}/{rng.choice('ld')}{rng.randrange(14)}/{rng.choice(['..', '.', 'x', 'l3', 'd2', '..//'])}/{rng.choice(['l1', 'y', '..', 'd4'])}" for _ in range(200)]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([*asked, asked[0], None])], "i long, path string")
    named = spark.createDataFrame([*table.items(), (None, "x"), ("x", None)], "link string, target string")
    got = {r.i: r for r in links.resolved(rows, named).collect()}
    assert len(got) == 202 and got[201].resolved is None and got[201].loop is None
    for i, path in enumerate([*asked, asked[0]]):
        want = followed(path, table)
        assert got[i].resolved == want and got[i].loop == (want is None)
        assert want is None or os.path.realpath(path) == want


def test_long_chains_and_circles(spark):
    """A chain of 500 links takes as few rounds as its logarithm; what leads into a circle is one."""
    chain = [(f"/c{i}", f"c{i + 1}") for i in range(500)] + [("/x", "/y"), ("/y", "/z"), ("/z", "/y"), ("/own", "/own/b"), ("/c7", "c8")]
    rows = spark.createDataFrame([("/c0/a/../b",), ("/x",), ("/own/q",), ("relative/./d",), ("/../..",)], "path string")
    got = {r.path: (r.resolved, r.loop) for r in links.resolved(rows, spark.createDataFrame(chain, "link string, target string"), base="/home").collect()}
    assert got == {"/c0/a/../b": ("/c500/b", False), "/x": (None, True), "/own/q": (None, True), "relative/./d": ("/home/relative/d", False), "/../..": ("/", False)}
    none = links.resolved(rows, spark.createDataFrame([], "link string, target string"))
    assert {r.path: r.resolved for r in none.collect()}["/c0/a/../b"] == "/c0/b"


def test_one_run_at_a_time(spark, store):
    import threading

    from tapeline.stores import Running, sole_run

    root, local = store
    with sole_run(spark, f"{root}/run"):
        with pytest.raises(Running, match="going on"), sole_run(spark, f"{root}/run"):
            pass
        with sole_run(spark, f"{root}/another"):
            pass
    with pytest.raises(KeyError), sole_run(spark, f"{root}/run"):  # a run that fails leaves no mark
        raise KeyError
    entered, both = [], threading.Barrier(4)

    def enter():
        both.wait()
        try:
            with sole_run(spark, f"{root}/race"):
                entered.append(1)
                waited.wait(30)
        except Running:
            entered.append(0)
            if len(entered) == 4:
                waited.set()

    waited = threading.Event()
    threads = [threading.Thread(target=enter) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(40)
    assert sorted(entered) == [0, 0, 0, 1]
    # the mark of a run that was killed
    os.makedirs(local / "dead", exist_ok=True)
    (local / "dead" / "_running").write_text("0 someone")
    with sole_run(spark, f"{root}/dead"):
        pass
    assert not (local / "dead" / "_running").exists()
