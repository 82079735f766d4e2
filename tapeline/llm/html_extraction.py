"""Main text of web pages: structure and host suffix arrays.

Each page is parsed into blocks in page order (text between block-level tags; character references decoded, white space one
space, trimmed; <br> is white space). A block is `chrome` if it lies in an element that by name, role, class, id or
visibility is a menu, header, footer, sidebar, notice, advert, form or comment section; `article` if it lies in an article
or main element, or in one named as content; else `other`. Scripts, styles, head and comments have no blocks.

The token streams of a host's pages (what stands outside their articles) are concatenated, page after page, and sorted into
a suffix array by prefix doubling. Neighbours in it that agree on `run` tokens are repeated substrings. A substring that repeats
may be boilerplate or the text of a page that has copies, and these are told apart in the array itself: a page has content of
its own if it has an article, or blocks that are mostly outside all substrings on `least_pages` or more distinct pages, with a
tenth of its tokens. Copies of a page have none, since everything on them repeats. Substrings on `least_pages` or more pages
with content of their own are boilerplate, wherever else they stand; what repeats on copies only is their text. A page's
main text is its article blocks and those of its `other` blocks of which less than half is covered by boilerplate, or which
stand in one unit (the innermost div, section, list, table cell) with such, most of the unit being free: a line that many
articles end with is part of each. So without any article markup copies keep their text and lose their boilerplate. Article blocks stay even where they repeat and chrome
goes even where it is unique: there structure overrules the suffix array.

A host is dealt into parts of about `part_pages` pages by a hash of page_id, so a host of any size is many bounded groups.
What repeats is counted over the host, not the part: the suffix array of each part of a divided host gives its distinct
runs with their pages, a Spark aggregate on (host, run) adds these up, and runs on enough pages go back to the parts that
have them; the same again for pages with content of their own. So a run counts on the same pages however the host is dealt. Small hosts share a task. Null html: empty text.
Null or relative url: host null, one host of its own. Repeated rows count as one page for repetition if their page_id is
equal (a null page_id is one page), and each gets its text. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import html as htmllib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import texts
from tapeline.session import materialise

RUN, LEAST_PAGES, PART_PAGES, TASK_PAGES = 8, 3, 200, 1000
#: Share of a page's text outside articles that makes it a page with content of its own.
OWN = 0.1
CHROME, OTHER, ARTICLE = "0", "1", "2"

#: Element names of HTML and words that name parts of a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
UNITS = frozenset("blockquote center details div dl ol section table td ul".split())
SILENT = frozenset("head title script style noscript template svg math iframe object select option textarea button canvas audio video datalist".split())
CHROME_NAMES = frozenset("nav header footer aside form menu dialog fieldset".split())
CHROME_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup share sharing "
    "social related recommended recommendations comment comments disqus replies reply respond form login search breadcrumb breadcrumbs pagination pager "
    "widget toolbar copyright skip".split()
)
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CONTENT_WORDS = frozenset("article content main post entry story".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|textarea|svg|title)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*>""", re.S | re.I)
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")


def _place(name: str, attributes: str, inside: str) -> str:
    """Where an element's text lies, given where the element itself lies."""
    if inside == CHROME:
        return CHROME
    if attributes and not attributes.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        if "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
            return CHROME
        if found.get("role", "").lower() in CHROME_ROLES:
            return CHROME
        words = set(_WORDS.findall((found.get("class", "") + " " + found.get("id", "")).lower()))
        marks = words & CHROME_WORDS
        if marks and name not in ("html", "body", "main") and not (inside == ARTICLE and marks <= {"header", "banner"}):
            return CHROME
        if found.get("role", "").lower() in ("main", "article") or words & CONTENT_WORDS and name in ("div", "section", "td"):
            return ARTICLE
    if name in CHROME_NAMES and not (name == "header" and inside == ARTICLE):
        return CHROME
    return ARTICLE if name in ("article", "main") else inside


def blocks(page: str) -> list[tuple[str, int, str]]:
    """(place, unit, text) of each block in page order. A unit is an element of UNITS, the innermost around the block; a block in
    none is a unit by itself."""
    out: list[tuple[str, int, str]] = []
    buffer: list[str] = []
    stack: list[tuple[str, str, int]] = []
    place, unit, last, at = OTHER, 0, 0, 0

    def flush() -> None:
        nonlocal last
        if buffer:
            if text := " ".join(htmllib.unescape("".join(buffer)).split()):
                last += not unit
                out.append((place, unit or last, text))
            buffer.clear()

    def close(name: str, stops: frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    silent = 0
    for m in _TAG.finditer(page):
        if m.start() > at and not silent:
            buffer.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            if m[1] and m[1].lower() == "textarea":
                flush()
            continue
        if name in BLOCK or name == "hr":
            flush()
        elif name == "br":
            buffer.append(" ")
        if name in SILENT:
            silent = max(0, silent + (-1 if m[2] else 1))
            continue
        if m[2]:
            close(name)
        elif name not in VOID and not m[4].rstrip().endswith("/"):
            if name in BLOCK:
                close("p", BLOCK - {"p"})
            if name in ("li", "dt", "dd", "tr", "td", "th"):
                close(name, frozenset(("ul", "ol", "dl", "table", "menu")))
            above = stack[-1][1] if stack else OTHER
            here = _place(name, m[4], above)
            if here != above and name not in BLOCK:
                flush()
            last += name in UNITS
            stack.append((name, here, last if name in UNITS else stack[-1][2] if stack else 0))
        now = stack[-1][1:] if stack else (OTHER, 0)
        if now != (place, unit):
            flush()
            place, unit = now
    if at < len(page) and not silent:
        buffer.append(page[at:])
    flush()
    return out


MARK = "\x1e"


def _parse(keep: str):
    """The blocks of each page whose place is in `keep`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parsed = [MARK.join(f"{place}{unit} {text.replace(MARK, ' ')}" for place, unit, text in blocks(page.as_py() or "") if place in keep) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(parsed, pa.string())], ["page_id", "url", "host", "blocks"])

    return run


def suffix_array(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order of their first `depth` tokens or more, and for each but the first whether it agrees with the one
    before on that many. Prefix doubling: ranks of length k give ranks of length 2k."""
    _, rank = np.unique(tokens, return_inverse=True)
    n, length = len(tokens), 1
    order = np.argsort(rank, kind="stable")
    while length < depth:
        step = min(length, depth - length)
        after = np.full(n, -1, np.int64)
        after[: n - step] = rank[step:]
        key = rank.astype(np.int64) * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank, length = new, length + step
    return order, rank[order][1:] == rank[order][:-1]


class Repeats:
    """The repeated runs of some token streams, by their suffix array; `owners` are the pages of the streams."""

    def __init__(self, streams: list[list[str]], owners: list[int], run: int = RUN):
        self.run, self.sizes = run, np.array([len(s) for s in streams])
        numbers: dict[str, int] = {}
        flat = np.fromiter((numbers.setdefault(t, len(numbers)) for s in streams for t in (*s, None)), np.int64, int(self.sizes.sum()) + len(streams))
        self.ends = np.cumsum(self.sizes + 1) - 1
        self.own = np.array([int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=8).digest(), "little") for t in numbers], np.uint64)[flat]
        flat[self.ends] = len(numbers) + np.arange(len(streams))  # a separator of its own ends each stream
        self.order, same = suffix_array(flat, run)
        self.owner = owner = np.repeat(np.array(owners, np.int64), self.sizes + 1)[self.order]
        self.group = np.concatenate([[0], np.cumsum(~same)])
        most = int(owner.max(initial=0)) + 1
        self.pages = np.bincount(np.unique(self.group * most + owner) // most, minlength=self.group[-1] + 1)
        # Runs that reach over the end of a stream are none.
        left = np.repeat(self.ends, self.sizes + 1) - np.arange(len(flat))
        self.whole = left[self.order] >= run

    def hashes(self) -> np.ndarray:
        """For each suffix in order: the hash of its first `run` tokens, the same in every part."""
        out = np.zeros(len(self.own), np.uint64)
        runs = texts.windows(self.own, self.run)
        out[: len(runs)] = runs
        return out[self.order].view(np.int64)

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct runs: hash and number of pages."""
        first = self._first()
        return self.hashes()[first], self.pages[self.group[first]]

    def _first(self) -> np.ndarray:
        """One suffix of each distinct run."""
        return np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]) & self.whole)

    def often(self, least_pages: int = LEAST_PAGES, elsewhere: np.ndarray | None = None) -> np.ndarray:
        """For each suffix, whether its run is on `least_pages` pages, or one of `elsewhere` (hashes)."""
        often = self.pages[self.group] >= least_pages
        if elsewhere is not None and len(elsewhere):
            often |= self.among(elsewhere)
        return often & self.whole

    def among(self, hashes: np.ndarray) -> np.ndarray:
        return np.isin(self.hashes(), hashes) & self.whole

    def marks(self, chosen: np.ndarray) -> list[np.ndarray]:
        """For each stream, which of its tokens lie in the runs of the suffixes `chosen`."""
        starts = self.order[chosen]
        change = np.zeros(len(self.own) + self.run + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + self.run, -1)
        marked = np.cumsum(change)[: len(self.own)] > 0
        return [marked[e - n : e] for e, n in zip(self.ends.tolist(), self.sizes.tolist(), strict=True)]

    def on_pages(self, chosen: np.ndarray, pages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the distinct runs among the suffixes `chosen`: hash, and on how many of `pages` (a flag a page) each is."""
        most = int(self.owner.max(initial=0)) + 1
        held = np.unique((self.group * most + self.owner)[chosen & pages[self.owner]])
        n = np.bincount(held // most, minlength=self.group[-1] + 1)
        first = self._first()
        first = first[chosen[first]]
        return self.hashes()[first], n[self.group[first]]


def _pages_of(group: pd.DataFrame) -> list[list[tuple[str, str, str]]]:
    """(place, unit, text) of each block of each page."""
    return [[(b[0], *b[1:].split(" ", 1)) for b in x.split(MARK)] if x else [] for x in group["blocks"]]


class Part:
    """The pages of one part of a host."""

    def __init__(self, group: pd.DataFrame, run: int):
        self.pages = _pages_of(group)
        self.owners = pd.factorize(group["page_id"], use_na_sentinel=False)[0]
        self.repeats = Repeats([[t for place, _, text in page if place != ARTICLE for t in text.split(" ")] for page in self.pages], self.owners.tolist(), run)

    def with_content(self, chosen: np.ndarray) -> np.ndarray:
        """For each page (by its number), whether it has content of its own: blocks mostly outside the runs `chosen`
        (which span short blocks), with OWN of the tokens of its `other` blocks, or an article. Copies of a page and pages of nothing but
        boilerplate have none."""
        out = np.zeros(int(self.owners.max(initial=0)) + 1, bool)
        for page, mark, owner in zip(self.pages, self.repeats.marks(chosen), self.owners.tolist(), strict=True):
            at = own = all_ = 0
            for place, _, text in page:
                if place == ARTICLE:
                    out[owner] = True
                    continue
                n = text.count(" ") + 1
                if place == OTHER:
                    all_ += n
                    own += n if 2 * mark[at : at + n].sum() < n else 0
                at += n
            out[owner] |= own > 0 and own >= OWN * all_
        return out

    def texts(self, boilerplate: np.ndarray) -> list[str]:
        """Each page's text without the `other` blocks that lie half or more in the runs `boilerplate`, as do their units."""
        out = []
        for page, mark in zip(self.pages, self.repeats.marks(boilerplate), strict=True):
            at, sizes, units = 0, [], {}
            for place, unit, text in page:
                n = 0 if place == ARTICLE else text.count(" ") + 1
                covered = int(mark[at : at + n].sum())
                sizes.append((n, covered))
                if place == OTHER:
                    units[unit] = units.get(unit, 0) + n - 2 * covered
                at += n
            kept = [text for (place, unit, text), (n, covered) in zip(page, sizes, strict=True) if place == ARTICLE or place == OTHER and (2 * covered < n or units[unit] > 0)]
            out.append("\n".join(kept))
        return out


def _by_part(pages: pd.DataFrame):
    return pages.groupby(["host", "part"], dropna=False, sort=False)


def _runs(run: int):
    """The distinct runs of each part, with the number of its pages that have them."""

    def task(pages: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (host, part), group in _by_part(pages):
            found, n = Part(group, run).repeats.found()
            out.append(pd.DataFrame({"host": host, "part": part, "run": found, "n": n}))
        return pd.concat(out)

    return task


_NONE = np.zeros(0, np.int64)


def _content_runs(run: int, least_pages: int):
    """The repeated runs of each part (`elsewhere`: those that repeat in others), with the number of its pages with content of their
    own that have them."""

    def task(pages: pd.DataFrame, elsewhere: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"host": pd.Series(dtype=object), "part": _NONE, "run": _NONE, "n": _NONE})]
        runs = {key: x["run"].to_numpy() for key, x in _by_part(elsewhere)}
        for key, group in _by_part(pages):
            part = Part(group, run)
            often = part.repeats.often(least_pages, runs.get(key))
            found, n = part.repeats.on_pages(often, part.with_content(often))
            out.append(pd.DataFrame({"host": key[0], "part": key[1], "run": found, "n": n}))
        return pd.concat(out)

    return task


def _main_texts(run: int, least_pages: int):
    """Texts of the pages of a task. Boilerplate of parts of divided hosts is given, that of whole hosts found here."""

    def task(pages: pd.DataFrame, boilerplate: pd.DataFrame) -> pd.DataFrame:
        pages = pages.reset_index(drop=True)
        found = pd.Series("", index=pages.index, dtype=object)
        runs = {key: x["run"].to_numpy() for key, x in _by_part(boilerplate)}
        for key, group in _by_part(pages):
            part = Part(group, run)
            if group["divided"].iloc[0]:
                known = runs.get(key, _NONE)
            else:
                often = part.repeats.often(least_pages)
                all_, n = part.repeats.on_pages(often, part.with_content(often))
                known = all_[n >= least_pages]
            found[group.index] = part.texts(part.repeats.among(known))
        return pd.DataFrame({"page_id": pages["page_id"], "url": pages["url"], "text": found, "n_chars": found.str.len().astype("int64")})

    return task


def extract(pages: DataFrame, run: int = RUN, least_pages: int = LEAST_PAGES, part_pages: int = PART_PAGES) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    host = F.lower(F.regexp_extract(F.col("url"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", F.coalesce(F.nullif(host, F.lit("")), F.lit("")))
    counts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    # Written first, so that its size is known: hosts of more than one part are few, and broadcast where they are.
    large = materialise(counts.where(F.col("n") > part_pages).select(F.col("host").alias("l_host"), F.ceil(F.col("n") / part_pages).alias("parts")), "html-hosts")
    tasks = max(1, -(-pages.count() // TASK_PAGES))

    def dealt(keep: str) -> DataFrame:
        parsed = rows.select("page_id", "url", "host", "html").mapInArrow(_parse(keep), "page_id long, url string, host string, blocks string")
        return parsed.join(large, parsed.host == F.col("l_host"), "left").withColumn("part", F.pmod(F.xxhash64("page_id"), F.coalesce("parts", F.lit(1))))

    # Runs of the parts of divided hosts, added up over the host: first on which pages they are, then on which with content of
    # their own. As many partitions as tasks: their size follows from TASK_PAGES, whatever the session's number of partitions.
    def tasks_of(df: DataFrame) -> DataFrame:
        return df.withColumn("task", F.pmod(F.xxhash64("host", "part"), F.lit(tasks))).repartition(tasks, "task")

    def added_up(counts: DataFrame) -> DataFrame:
        return counts.groupBy("host", "run").agg(F.sum("n").alias("all")).where(F.col("all") >= least_pages).select("host", "run")

    columns = "host string, part long, run long, n long"
    outside = dealt(CHROME + OTHER).where("parts is not null").select("page_id", "host", "part", "blocks")
    runs = materialise(tasks_of(outside).groupBy("task").applyInPandas(_runs(run), columns), "html-runs")
    elsewhere = runs.where(F.col("n") < least_pages).join(added_up(runs), ["host", "run"]).select("host", "part", "run")
    pages_of_divided = dealt(CHROME + OTHER + ARTICLE).where("parts is not null").select("page_id", "host", "part", _without_articles(F.col("blocks")).alias("blocks"))
    content = tasks_of(pages_of_divided).groupBy("task").cogroup(tasks_of(elsewhere).groupBy("task")).applyInPandas(_content_runs(run, least_pages), columns)
    content = materialise(content, "html-content-runs")
    boilerplate = content.join(added_up(content), ["host", "run"]).select("host", "part", "run")
    keyed = dealt(CHROME + OTHER + ARTICLE).select("page_id", "url", "host", "part", "blocks", F.col("parts").isNotNull().alias("divided"))
    return tasks_of(keyed).groupBy("task").cogroup(tasks_of(boilerplate).groupBy("task")).applyInPandas(
        _main_texts(run, least_pages), "page_id long, url string, text string, n_chars long"
    )


def _without_articles(blocks: Column) -> Column:
    """Blocks with the text of articles cut to a mark that there is one."""
    return F.array_join(F.transform(F.split(blocks, MARK), lambda b: F.when(F.startswith(b, F.lit(ARTICLE)), F.lit(f"{ARTICLE}0 ")).otherwise(b)), MARK)
