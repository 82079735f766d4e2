import html
import re

import numpy as np

from tapeline.llm import html_extraction as x


def texts(spark, *pages):
    rows = [(i, f"http://h.com/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in x.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_articles_of_the_fixture(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    got = x.extract(spark.read.parquet(f"{sf}/pages.parquet")).toPandas().set_index("page_id")
    for page, source in zip(pages.page_id, pages.html, strict=True):
        inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert got.text[page] == want and got.n_chars[page] == len(want)


def test_structure(spark):
    got = texts(
        spark,
        "<article><header><h1>T</h1></header><p>b</p><aside>z</aside><section class='comments'>c</section></article><p>out</p>",
        "<p>a&nbsp;b &lt;c&gt;<br>d<p>e<ul><li>x<li>y</ul><form>f<p>g</form><div class='cookie-notice'><p>no</p></div>tail<script>x='</p>'</script><!-- c --><textarea>t</textarea>",
        "<div class=\"post-content\"><p>in <b>bold</b>er &#233;&eacute;</p></div><div>other</div><div hidden>no</div>",
        "a < b <p title='>'>c",
        None,
        "",
    )
    assert got == ["T\nb\nout", "a b <c> d\ne\nx\ny\ntail", "in bolder éé\nother", "a < b\nc", "", ""]


def test_repeated_runs_go_and_unique_ones_stay(spark):
    same = "<div>Welcome to our very nice site with many many things to see today</div>"
    pages = [f"<body>{same}<div>unique text number {i} about {i * 7} and {i * 13}</div></body>" for i in range(4)]
    assert texts(spark, *pages) == [f"unique text number {i} about {i * 7} and {i * 13}" for i in range(4)]
    # two pages are no boilerplate
    assert "Welcome" in texts(spark, *pages[:2])[0]


def test_coverage_matches_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(30):
        streams = [[str(t) for t in rng.integers(0, 4, rng.integers(0, 60))] for _ in range(6)]
        owners = rng.integers(0, 4, 6).tolist()
        repeats = x.Repeats(streams, owners, run=4)
        got = repeats.marks(repeats.often(least_pages=2))
        seen = {}
        for s, o in zip(streams, owners, strict=True):
            for i in range(len(s) - 3):
                seen.setdefault(tuple(s[i : i + 4]), set()).add(o)
        for s, mark in zip(streams, got, strict=True):
            want = np.zeros(len(s), bool)
            for i in range(len(s) - 3):
                if len(seen[tuple(s[i : i + 4])]) >= 2:
                    want[i : i + 4] = True
            assert (want == mark).all()


def test_large_host_is_dealt_out(spark):
    same = "<div>one two three four five six seven eight nine ten</div>"
    pages = [f"{same}<p>page {i} has its own words {i * 31}</p>" for i in range(60)]
    rows = spark.createDataFrame([(i, "http://h.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in x.extract(rows, part_pages=10).collect()}
    assert got == {i: f"page {i} has its own words {i * 31}" for i in range(60)}


def test_runs_count_over_the_host_however_it_is_dealt(spark):
    """A notice on three pages of a host goes, one on two stays, in one part and in many."""
    rare = "<div>this one notice stands on only three pages of the host here</div>"
    twice = "<div>and that other notice stands on no more than two pages</div>"
    pages = [(rare if i in (5, 50, 95) else twice if i in (7, 70) else "") + f"<p>page {i} has its own words {i * 31} and more {i * 17}</p>" for i in range(100)]
    rows = spark.createDataFrame([(i, "http://h.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    whole, parts = ({r.page_id: r.text for r in x.extract(rows, part_pages=n).collect()} for n in (1000, 4))
    assert whole == parts
    assert not any("this one notice" in t for t in whole.values()) and sum("and that other" in t for t in whole.values()) == 2


def test_structured_pages_keep_what_is_unique_outside_the_article(spark):
    same = "<div>Read on about our other fine things in the shop today please</div>"
    pages = [f"{same}<div>Teaser {i} of its own</div><article><p>text {i}</p></article>" for i in range(4)]
    assert texts(spark, *pages) == [f"Teaser {i} of its own\ntext {i}" for i in range(4)]


def test_awkward_pages(spark):
    rows = [(None, None, "<p>x"), (1, "u", "<p>y"), (1, "u", "<p>y"), (2, "http://h/", "<p>" + "w " * 50_000)]
    got = x.extract(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS part", "3 AS blocks")).collect()
    assert sorted(r.text[:1] for r in got) == ["w", "x", "y", "y"]
    assert x.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_without_article_markup_the_array_decides(spark):
    """Pages of the fixture with their articles as plain divs: as good as all keep their text, copies too; none is empty."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = pages.selectExpr("page_id", "url", "regexp_replace(html, '(</?)article', '$1div') AS html")
    want = {r.page_id: r.text for r in x.extract(pages).collect()}
    got = {r.page_id: r.text for r in x.extract(bare).collect()}
    assert all(got.values()) and sum(got[i] == want[i] for i in want) >= 0.99 * len(want)


def test_copies_stay_and_boilerplate_goes_everywhere(spark):
    """Five copies, two of them with changed words, a page of nothing but boilerplate, four pages of their own."""
    same = "<div>Read on about our other fine things in the shop today please</div>"
    line = "<p>All of this text may be copied under the terms of the site</p>"
    text = [f"word{i} goes with thing{i * 7} and then with other{i * 3} until end{i}" for i in range(12)]
    article = lambda words: "<div>" + "".join(f"<p>{w}</p>" for w in words) + line + "</div>"
    changed = [t.replace("until", "til") if i % 5 == 0 else t for i, t in enumerate(text)]
    own = [[f"page {k} says {i * k} and also {i + k} so that it is {k * 97 + i} there" for i in range(5)] for k in range(4)]
    pages = [same + article(w) for w in (text, text, changed, changed, text, *own)] + [same]
    keep = line[3:-4]
    want = ["\n".join([*w, keep]) for w in (text, text, changed, changed, text, *own)] + [""]
    assert texts(spark, *pages) == want
    rows = spark.createDataFrame([(i, "http://h.com/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    assert [r.text for r in x.extract(rows, part_pages=2).orderBy("page_id").collect()] == want
    # with the array switched off boilerplate stays
    assert x.extract(rows, least_pages=1000).where("text like 'Read on%'").count() == 10


def plain(pages, run, least):
    """The rule on lists of (place, unit, text), pages being distinct, without a suffix array."""
    streams = [[(k, t) for k, (place, _, text) in enumerate(p) if place != x.ARTICLE for t in text.split(" ")] for p in pages]
    seen = {}
    for o, s in enumerate(streams):
        for i in range(len(s) - run + 1):
            seen.setdefault(tuple(t for _, t in s[i : i + run]), set()).add(o)

    def covered(runs):
        out = []
        for s in streams:
            mark = [False] * len(s)
            for i in range(len(s) - run + 1):
                if tuple(t for _, t in s[i : i + run]) in runs:
                    mark[i : i + run] = [True] * run
            counts = {}
            for (k, _), m in zip(s, mark, strict=True):
                n, c = counts.get(k, (0, 0))
                counts[k] = n + 1, c + m
            out.append(counts)
        return out

    content = set()
    for o, (page, counts) in enumerate(zip(pages, covered({r for r, where in seen.items() if len(where) >= least}), strict=True)):
        sizes = [counts[k] for k, (place, _, _) in enumerate(page) if place == x.OTHER]
        own = sum(n for n, c in sizes if 2 * c < n)
        if any(place == x.ARTICLE for place, _, _ in page) or own and own >= x.OWN * sum(n for n, _ in sizes):
            content.add(o)
    boilerplate = {r for r, where in seen.items() if len(where & content) >= least}
    out = []
    for page, counts in zip(pages, covered(boilerplate), strict=True):
        kept = []
        for k, (place, unit, text) in enumerate(page):
            free = sum(counts[j][0] - 2 * counts[j][1] for j, (p, u, _) in enumerate(page) if p == x.OTHER and u == unit)
            if place == x.ARTICLE or place == x.OTHER and (2 * counts[k][1] < counts[k][0] or free > 0):
                kept.append(text)
        out.append("\n".join(kept))
    return out


def test_rule_matches_brute_force(spark):
    """Few words and shared sentences, so that pages are copies, mixtures and boilerplate; whole hosts and hosts in parts."""
    rng = np.random.default_rng(11)
    sentences = [" ".join(rng.choice(["a", "b", "c", "d"], rng.integers(3, 14))) for _ in range(14)]
    for seed in range(4):
        rng = np.random.default_rng(seed)
        html_ = []
        for i in range(18):
            body = [str(rng.choice(sentences)) if rng.random() < 0.7 else " ".join(f"u{v}" for v in rng.integers(0, 10**6, rng.integers(4, 16))) for _ in range(rng.integers(1, 6))]
            body = html_body if i % 3 == 2 else body  # a copy of the page before
            html_body = body
            kind = ["<div>{}</div>", "<p>{}</p>", "<article>{}</article>", "<nav>{}</nav>"]
            html_.append("".join(kind[j] .format(f"<p>{a}</p><p>{b}</p>") for a, b, j in zip(body, body[::-1], rng.choice(4, len(body), p=[0.6, 0.2, 0.05, 0.15]), strict=True)))
        want = plain([x.blocks(h) for h in html_], 8, 3)
        rows = spark.createDataFrame([(i, "http://h.com/", h) for i, h in enumerate(html_)], "page_id long, url string, html string")
        for parts in (1000, 3):
            assert [r.text for r in x.extract(rows, part_pages=parts).orderBy("page_id").collect()] == want
