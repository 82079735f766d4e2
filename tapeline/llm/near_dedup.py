"""Near-duplicate documents by a chosen-path set similarity join.

Words are runs without ASCII white space after lower-casing A-Z; a document's set holds its distinct shingles of `width`
words (with fewer words, the whole sequence; without words, empty and linked with nothing). Documents are linked when
100 * intersection >= `percent` * union, on full sets. A component's id is its smallest doc_id; that document stays.

1. Documents with equal sets are one class, represented by its smallest doc_id.
2. Every tree puts a representative into the node of its minwise token. Small nodes (up to `small` members) are compared
   exhaustively; in larger ones all members are compared with a few pivots. Confirmed pairs give first components, so
   that a dense group is one component at a cost of some comparisons a member.
3. Large nodes whose members lie in several components are searched by recursion. A node is small now if its minority (the
   members outside its largest component) is: every member of the minority is compared with every member of another
   component. Other nodes branch: each member goes to `branches` children, by its minwise tokens under permutations that
   the node draws. Nodes of the last level are compared like small ones whatever their minority: no member, node or pair
   is ever left out, only pairs that are in one component already. A comparison emits no pairs but a spanning forest of
   the components that it finds close; what the forests connect is a cluster.
4. A candidate agrees in at least `agree` of 128 16-bit minwise values (5 standard deviations below the mean of a pair at
   the limit, 1e-6). Candidates are confirmed on full sets: those of step 2 in the cell where they were found, so that a
   set moves once a cell and not once a pair; those of step 3 in their cluster, the minority with all members of large
   nodes in bounded cells, whose output again is a spanning forest, of links.

Recall: a pair at the limit p shares no node of level 0 in one tree with probability 1 - p, and each of at most `levels`
branchings parts it with (1 - p)**branches. Ten trees at p = 0.85 miss it with at most 6e-9 where nodes are small and
2e-7 after three branchings of two; at p = 0.8 with 1e-7 and 5e-6. Closer pairs are missed less, and components that are
joined by several pairs less still.

Skew: nodes over 1/4096 of all rows number at most 4096 by count, so their figures are broadcast and their members stay
where they are; members meet pivots and minorities in cells of bounded size, whatever the node's.

Null text: empty set. Null doc_id: linked with nothing, stays (its component_id is null). Rows that share a doc_id are one
vertex of the graph; `drop_near_duplicates` keeps one row of each component, the first by (doc_id, place), and
every row without words. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.llm import texts
from tapeline.llm.common import PLACE, without
from tapeline.llm.exact_dedup import located
from tapeline.session import materialise

TREES, SKETCH = 10, 128
SMALL, PIVOTS, LEVELS, BRANCHES, PERCENT, WIDTH = 32, 2, 3, 2, 85, 3
MINORITY, CELL, MINOR, HOT = 2048, 2048, 1024, 4096  # minority of a small node; members and minority of a cell; most hot nodes
SHINGLES = 1 << 20  # of the members of a cell that holds full sets

_rng = np.random.Generator(np.random.PCG64(7))
_FACTORS = _rng.integers(0, 2**31, SKETCH + TREES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def least_agreement(percent: int) -> int:
    """Equal minwise values that a pair at the limit has but for five standard deviations of chance."""
    p = percent / 100
    return math.floor(SKETCH * p - 5.1 * math.sqrt(SKETCH * p * (1 - p)))


def _sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for chunk in texts.chunks(column):
        starts, ends, first = chunk.words()
        h = chunk.spans(starts, ends, fold=True)
        shingles = texts.windows(h, width)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield np.unique(shingles[a : b - width + 1]) if b - a >= width else texts.windows(h[a:b] * texts.K2, b - a)


def _minima(items: np.ndarray) -> np.ndarray:
    """The least value of the set under each permutation."""
    x = (items ^ (items >> np.uint64(32))).astype(np.uint32)[:, None]
    out = np.full(SKETCH + TREES, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(out, (x[i : i + 4096] * _FACTORS).min(0), out=out)
    return out


def _signatures(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, sketch, tokens = [], [], [], []
            for items in _sets(batch.column("text"), width):
                n.append(len(items))
                digest.append(hashlib.blake2b(items.tobytes(), digest_size=16).digest())
                least = _minima(items)
                sketch.append(least[:SKETCH].astype(np.uint16).tobytes())
                tokens.append(least[SKETCH:].view(np.int32))
            flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tokens) + 1) * TREES, pa.int32()), pa.array(flat))
            found = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketch, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), *found], ["doc_id", "place", "n", "digest", "sketch", "tokens"])

    return run


def signatures(docs: DataFrame, width: int = WIDTH, place: Column | None = None) -> DataFrame:
    """doc_id, place, n (set size), digest of the set, sketch, tree tokens."""
    place = F.lit(None).cast(PLACE) if place is None else place
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), F.col("text").cast("string").alias("text")).mapInArrow(
        _signatures(width), f"doc_id long, place {PLACE}, n long, digest binary, sketch binary, tokens array<int>"
    )


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            keys = [batch.column(k) for k in ("doc_id", "paired", "large")]
            for i, items in enumerate(_sets(batch.column("text"), width)):
                held.append(items.view(np.int64))
                size += len(items)
                if size > 1 << 20 or i == batch.num_rows - 1:
                    ends = np.cumsum([0] + [len(x) for x in held]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held)))
                    yield pa.RecordBatch.from_arrays([*(k.slice(at, len(held)) for k in keys), lists], ["id", "paired", "large", "items"])
                    at, held, size = i + 1, [], 0

    return run


#: A pair, the agreement of its sketches, and the cell where it was found.
PAIRS = "a long, b long, est int, cell long"
MEMBER = ("rep", "n", "sketch")


def _emit(a: np.ndarray, b: np.ndarray, est: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    columns = np.minimum(a, b), np.maximum(a, b), est.astype(np.int32), cell
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "est", "cell"])


def _agreement(s: np.ndarray, t: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal values of the sketches s[i] and t[j]."""
    out = np.zeros(len(i), np.int32)
    for lo in range(0, len(i), 1 << 15):
        at = slice(lo, lo + (1 << 15))
        out[at] = (s[i[at]] == t[j[at]]).sum(1)
    return out


def _sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SKETCH)


def _near(n1: np.ndarray, n2: np.ndarray, percent: int) -> np.ndarray:
    """Set sizes that can belong to linked sets."""
    return 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that hold whole groups of equal `key` (rows come sorted by it), and where the groups start and end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            keys = batch.column(key).to_numpy()
            change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
            if len(change):
                whole = pa.concat_batches([*held[:-1], batch.slice(0, int(change[-1]))])
                held = [batch.slice(int(change[-1]))]
                yield whole, _edges(whole.column(key).to_numpy())
            elif len(held) > 1 and held[-2].column(key)[-1].as_py() != keys[0]:
                whole, held = pa.concat_batches(held[:-1]), [batch]
                yield whole, _edges(whole.column(key).to_numpy())
    if held:
        whole = pa.concat_batches(held)
        yield whole, _edges(whole.column(key).to_numpy())


def _edges(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def _within(percent: int, agree: int):
    """Pairs of the members of small nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _runs(batches, "cell"):
            ids, sizes, cell = (batch.column(k).to_numpy() for k in ("rep", "n", "cell"))
            sketches = _sketches(batch.column("sketch"))
            pairs = [lo + np.array(np.triu_indices(hi - lo, 1)) for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
            i, j = np.concatenate(pairs, 1)
            ok = _near(sizes[i], sizes[j], percent) & (ids[i] != ids[j])
            i, j = i[ok], j[ok]
            est = _agreement(sketches, sketches, i, j)
            ok = est >= agree
            yield _emit(ids[i[ok]], ids[j[ok]], est[ok], cell[i[ok]])

    return run


def _across(percent: int, agree: int):
    """Pairs (rep, other) whose rows hold both sketches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (batch.column(k).to_numpy() for k in ("rep", "p_rep"))
            est = (_sketches(batch.column("sketch")) == _sketches(batch.column("p_sketch"))).sum(1)
            ok = (est >= agree) & (a != b) & _near(batch.column("n").to_numpy(), batch.column("p_n").to_numpy(), percent)
            yield _emit(a[ok], b[ok], est[ok], batch.column("cell").to_numpy()[ok])

    return run


def _linked(a: np.ndarray, others: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets `others` are linked with the set `a`."""
    out, at = [np.zeros(0, bool)], 0
    while at < len(others):
        ends = np.cumsum([len(x) for x in others[at : at + 4096]])
        some = others[at : at + max(1, int(np.searchsorted(ends, 1 << 21)))]
        ends = ends[: len(some)]
        sizes = np.diff(ends, prepend=0)
        flat = np.concatenate(some)
        found = a[np.minimum(np.searchsorted(a, flat), len(a) - 1)] == flat
        both = np.add.reduceat(found, ends - sizes, dtype=np.int64)
        out.append(100 * both >= percent * (len(a) + sizes - both))
        at += len(some)
    return np.concatenate(out)


def _between(percent: int, agree: int, exact: bool):
    """A spanning forest of each cell's components: of its minority with all members, by candidates, or by links of full
    sets (`exact`). Rows (a, b) are components, or documents if exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, edges in _runs(batches, "cell"):
            ids, sizes, label = (batch.column(k).to_numpy() for k in ("rep", "n", "label"))
            sketches = _sketches(batch.column("sketch"))
            minor = batch.column("minor").to_numpy(zero_copy_only=False).astype(bool)
            found = []
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                few, many = lo + np.flatnonzero(minor[lo:hi]), lo + np.flatnonzero(~minor[lo:hi])
                root = np.unique(label[lo:hi], return_inverse=True)[1]  # the tree of the forest that a row is in
                at, step = 0, 1
                while at < len(few):
                    rows = few[at : at + step]
                    at, step = at + step, min(2 * step, 64)
                    i, j = np.nonzero((root[rows - lo][:, None] != root[many - lo][None, :]) & _near(sizes[rows][:, None], sizes[many][None, :], percent))
                    i, j = rows[i], many[j]
                    ok = _agreement(sketches, sketches, i, j) >= agree
                    i, j = i[ok], j[ok]
                    if exact and len(i):
                        sets = lambda k: batch.column("items")[int(k)].values.to_numpy().view(np.uint64)  # noqa: E731, B023
                        ends = np.flatnonzero(np.diff(i)) + 1
                        ok = [_linked(sets(x[0]), [sets(k) for k in y], percent) for x, y in zip(np.split(i, ends), np.split(j, ends), strict=True)]
                        ok = np.concatenate(ok)
                        i, j = i[ok], j[ok]
                    for x, y in zip(i.tolist(), j.tolist(), strict=True):
                        p, q = root[x - lo], root[y - lo]
                        if p != q:
                            root[root == p] = q
                            found.append((ids[x], ids[y]) if exact else (label[x], label[y]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def _confirm(percent: int):
    """A spanning forest of the linked pairs of each cell: rows without `b` hold the set of `a`, and come before the pairs."""

    def top(parent: dict[int, int], x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets, parent = None, {}, {}
        for batch in batches:
            cells, first, second, items = (batch.column(k) for k in ("cell", "a", "b", "items"))
            cells, first, paired = cells.to_numpy(), first.to_numpy(), second.is_valid().to_numpy(zero_copy_only=False)
            second = second.fill_null(0).to_numpy()
            groups = np.flatnonzero((cells[1:] != cells[:-1]) | (first[1:] != first[:-1]) | (paired[1:] != paired[:-1])) + 1
            found = []
            for lo, hi in zip([0, *groups.tolist()], [*groups.tolist(), batch.num_rows], strict=True):
                if hi <= lo:
                    continue
                if cells[lo] != now:
                    now, sets, parent = cells[lo], {}, {}
                if not paired[lo]:
                    sets[first[lo]] = items[lo].values.to_numpy().view(np.uint64)  # sorted as such
                elif first[lo] in sets:
                    x = int(first[lo])
                    apart = [y for y in second[lo:hi].tolist() if y in sets and top(parent, y) != top(parent, x)]
                    for y, ok in zip(apart, _linked(sets[x], [sets[y] for y in apart], percent).tolist(), strict=True):
                        if ok and top(parent, x) != top(parent, y):
                            parent[top(parent, y)] = top(parent, x)
                            found.append((x, y))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the least vertex reachable, for each vertex of `edges` (a, b). Labels spread to neighbours and jump to
    the label of their label, one written table a round, until nothing changes."""
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).select(F.col("a").alias("v"), "label", F.lit(True).alias("moved"))
    while True:
        labels = materialise(labels, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("v", "label")
        heard = both.join(labels, both.a == labels.v).groupBy("b").agg(F.min("label").alias("heard")).withColumnRenamed("b", "w")
        jump = labels.select(F.col("v").alias("u"), F.col("label").alias("jumped"))
        near = labels.select("v", "label").join(heard, F.col("v") == F.col("w")).join(jump, F.col("label") == F.col("u"))
        labels = near.select("v", F.least("heard", "jumped").alias("next"), "label").select("v", F.least("next", "label").alias("label"), (F.col("next") < F.col("label")).alias("moved"))


def _in_tree(tree: Column, *cols: Column) -> Column:
    """A number from `cols` whose leading bits are the tree, so that the least cell of a pair is one of its first tree."""
    return F.shiftleft(tree.cast("long"), 58) + F.shiftrightunsigned(F.xxhash64(*cols), 6)


def _tree() -> Column:
    return F.shiftright("node", 58)


def _child(level: int, branch: int) -> Column:
    at = F.pmod(F.xxhash64(F.lit(level), F.lit(branch), "node"), F.lit(SKETCH))
    return _in_tree(_tree(), F.col("node"), at, F.substring("sketch", (2 * at + 1).cast("int"), F.lit(2)))


def _with_figures(rows: DataFrame, figures: DataFrame) -> DataFrame:
    """`rows` of the nodes in `figures` (node, size, ...), a written table. Figures of nodes with over 1/HOT of all rows are
    broadcast, at most HOT of them; others have few enough rows to be dealt by node."""
    total = figures.agg(F.sum("size")).first()[0] or 0
    limit = max(total // HOT, CELL)
    hot = figures.where(F.col("size") > limit)
    dealt = rows.join(F.broadcast(hot.select("node")), "node", "left_anti").join(figures.where(F.col("size") <= limit), "node")
    return rows.join(F.broadcast(hot), "node").unionByName(dealt)


def _parts(count: str, most: int, shingles: str | None = None, most_shingles: int = SHINGLES) -> Column:
    """Cells for `count` rows, of about `most`, and of about `most_shingles` of the `shingles` in all."""
    rows = F.col(count) / most
    return F.ceil(rows if shingles is None else F.greatest(rows, F.col(shingles) / most_shingles)).cast("int")


def _each(parts: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), parts - 1))


class Join:
    """The join over `docs`: classes of equal sets, candidates, confirmed links and components."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, width: int = WIDTH, small: int = SMALL, pivots: int = PIVOTS, levels: int = LEVELS, branches: int = BRANCHES, minority: int = MINORITY, trees: int = TREES, place: Column | None = None):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.percent, self.width, self.small, self.pivots, self.levels, self.branches, self.minority = percent, width, small, pivots, levels, branches, minority
        self.agree, self.trees = least_agreement(percent), min(trees, TREES)
        self.signatures = materialise(signatures(docs, width, place), "near-signatures")
        self.classes = materialise(
            self.signatures.where("n > 0 and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n", "sketch", "tokens")).alias("r"))
            .select("digest", F.col("r.doc_id").alias("rep"), "r.n", "r.sketch", "r.tokens"),
            "near-classes",
        )

    def build_sets(self, pairs: DataFrame, large: DataFrame | None) -> None:
        """Full sets of the documents of `pairs` and of `large` nodes, flagged so that each use moves its own, from their texts,
        which are shuffled; merging whatever the sizes, so that the cost grows as the input does."""
        ids = pairs.select(F.explode(F.array("a", "b")).alias("id"), F.lit(True).alias("paired"), F.lit(False).alias("large"))
        if large is not None:
            ids = ids.union(large.select("rep", F.lit(False), F.lit(True)))
        ids = ids.groupBy("id").agg(F.max("paired").alias("paired"), F.max("large").alias("large"))
        wanted = self.docs.join(ids.hint("merge"), F.col("doc_id") == F.col("id")).select("doc_id", "paired", "large", "text")
        self.sets = materialise(wanted.mapInArrow(_full_sets(self.width), "id long, paired boolean, large boolean, items array<long>"), "near-sets")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b, cell) of a written table whose full sets are linked."""
        needed = pairs.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct()
        sets = needed.join(self.sets.where("paired"), "id").select("cell", F.col("id").alias("a"), F.lit(None).cast("long").alias("b"), "items")
        rows = sets.union(pairs.select("cell", "a", "b", F.lit(None).cast("array<long>"))).withColumn("paired", F.col("b").isNotNull())
        return rows.repartition("cell").sortWithinPartitions("cell", "paired", "a").drop("paired").mapInArrow(_confirm(self.percent), "a long, b long").distinct()

    def meet(self) -> tuple[DataFrame, DataFrame | None]:
        """Pairs that level 0 of the trees finds, and the members of its large nodes (None: there are none)."""
        tagged = F.transform(F.slice("tokens", 1, self.trees), lambda x, i: _in_tree(i, x))
        nodes = self.classes.select("rep", "n", F.explode(tagged).alias("node"))
        figures = materialise(nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).where("size > 1"), "near-sizes")
        # Sketches join the rows that are left: most nodes have one member.
        live = materialise(_with_figures(nodes, figures).join(self.classes.select("rep", "sketch"), "rep"), "near-nodes")
        few = live.where(F.col("size") <= self.small).select(F.col("node").alias("cell"), *MEMBER).repartition("cell").sortWithinPartitions("cell")
        pairs = few.mapInArrow(_within(self.percent, self.agree), PAIRS)
        large = live.where(F.col("size") > self.small)
        if large.isEmpty():
            large = None
        else:
            pairs = pairs.union(self._with_pivots(large))
        return self._distinct(pairs), large

    def _distinct(self, pairs: DataFrame) -> DataFrame:
        return materialise(pairs.groupBy("a", "b").agg(F.max("est").alias("est"), F.min("cell").alias("cell")), "near-candidates")

    def _with_pivots(self, large: DataFrame) -> DataFrame:
        cells = _parts("size", CELL, "shingles")
        r = F.xxhash64("node", "rep")
        one = [F.min(F.when(F.pmod(r, F.lit(self.pivots)) == i, F.struct(r.alias("r"), *MEMBER))) for i in range(self.pivots)]
        chosen = large.groupBy("node").agg(F.first(cells).alias("cells"), F.array_compact(F.array(*one)).alias("p")).select("node", F.explode("p").alias("p"), "cells")
        chosen = chosen.select("node", *(F.col(f"p.{c}").alias(f"p_{c}") for c in MEMBER), _each(F.col("cells")).alias("c"))
        dealt = large.withColumn("c", F.pmod(F.xxhash64("rep"), cells).cast("int"))
        met = dealt.join(chosen, ["node", "c"]).select(_in_tree(_tree(), "node", "c").alias("cell"), *MEMBER, *(f"p_{c}" for c in MEMBER))
        return met.mapInArrow(_across(self.percent, self.agree), PAIRS)

    def _forest(self, members: DataFrame, cells: Column, parts: Column, exact: bool = False) -> DataFrame:
        """Forests (a, b) of the nodes of `members`, which have the node's `main` component: its members are dealt into `cells`
        and its minority into `parts`, and each of the ones meets each of the others."""
        columns = [*MEMBER, "label", *(["items"] if exact else [])]
        many = members.select("node", *columns, F.pmod(F.xxhash64("rep"), cells).cast("int").alias("c"), _each(parts).alias("p"), F.lit(False).alias("minor"))
        few = members.where("label != main").select("node", *columns, _each(cells).alias("c"), F.pmod(F.xxhash64("rep", F.lit(1)), parts).cast("int").alias("p"), F.lit(True).alias("minor"))
        rows = many.union(few).select(F.xxhash64("node", "c", "p").alias("cell"), *columns, "minor")
        return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_between(self.percent, self.agree, exact), "a long, b long")

    def branch(self, large: DataFrame, labels: DataFrame) -> DataFrame:
        """A forest (a, b) of the components of `labels` that have candidates among the members of large nodes."""
        known = labels.select(F.col("v").alias("rep"), "label")
        nodes = large.select("node", *MEMBER).join(known, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        found = []
        for level in range(self.levels + 1):
            nodes = materialise(nodes, "near-members")
            figures = nodes.groupBy("node", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.sum("c").alias("size"), F.max(F.struct("c", "label")).alias("m"))
            figures = figures.select("node", "size", F.col("m.label").alias("main"), (F.col("size") - F.col("m.c")).alias("outside")).where("outside > 0")
            figures = materialise(figures, "near-figures")
            live = _with_figures(nodes, figures)
            small = F.lit(level == self.levels) | (F.col("outside") <= self.minority)
            found.append(materialise(self._forest(live.where(small), _parts("size", CELL), _parts("outside", MINOR)), "near-forest"))
            if level == self.levels or figures.where(F.col("outside") > self.minority).isEmpty():
                break
            children = F.explode(F.array(*(_child(level, i) for i in range(self.branches))))
            nodes = live.where(~small).select(children.alias("child"), *MEMBER, "label").withColumnRenamed("child", "node")
        return reduce(DataFrame.union, found).distinct()

    def between_components(self, large: DataFrame, labels: DataFrame, forest: DataFrame) -> DataFrame:
        """Links (a, b) between the components of each cluster of `forest`, on full sets: those that join all that are linked.
        Only members of large nodes can have links that aren't known: documents that meet in a small node were compared there."""
        clusters = components(forest).select(F.col("v").alias("node"), F.col("label").alias("cluster"))
        known = labels.select(F.col("v").alias("rep"), "label")
        reps = large.groupBy("rep").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")).join(known, "rep", "left").withColumn("node", F.coalesce("label", "rep")).drop("label")
        by_label = materialise(reps.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).join(clusters, "node"), "near-figures")
        sums = by_label.groupBy("cluster").agg(F.sum("size").alias("all"), F.sum("shingles").alias("all_shingles"), F.max(F.struct("size", "node", "shingles")).alias("m"))
        sums = sums.select(
            "cluster", _parts("all", CELL, "all_shingles").alias("cells"), F.col("m.node").alias("main"), (F.col("all") - F.col("m.size")).alias("outside"),
            (F.col("all_shingles") - F.col("m.shingles")).alias("outside_shingles"),
        )
        figures = materialise(by_label.join(sums, "cluster").select("node", "size", "cluster", "main", "cells", _parts("outside", MINOR, "outside_shingles", SHINGLES // 2).alias("parts")), "near-clusters")
        members = _with_figures(reps, figures).select(F.col("cluster").alias("node"), F.col("node").alias("label"), *MEMBER, "main", "cells", "parts")
        members = members.join(self.sets.where("large").select(F.col("id").alias("rep"), "items"), "rep")
        return self._forest(members, F.col("cells"), F.col("parts"), exact=True)

    def labels(self) -> DataFrame:
        """(v, label) for the representatives that are linked with another."""
        pairs, large = self.meet()
        self.build_sets(pairs, large)
        links = materialise(self.confirmed(pairs), "near-links")
        labels = components(links)
        if large is None:
            return labels
        forest = materialise(self.branch(large, labels), "near-forest")
        if forest.isEmpty():
            return labels
        new = materialise(self.between_components(large, labels, forest), "near-links")
        return labels if new.isEmpty() else components(links.union(new))

    def rows(self) -> DataFrame:
        """One row per document: doc_id, place, n, component."""
        by_class = self.classes.select("digest", "rep").join(self.labels().withColumnRenamed("v", "rep"), "rep", "left")
        by_class = by_class.select("digest", F.coalesce("label", "rep").alias("component"))
        joined = self.signatures.select("doc_id", "place", "n", "digest").join(by_class, "digest", "left")
        component = F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
        return joined.select("doc_id", "place", "n", F.when(F.col("doc_id").isNotNull(), component).alias("component"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept")
    return Join(docs, **options).rows().select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), kept)


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one of each component, all rows without words or doc_id."""
    docs, place = located(docs)
    rows = materialise(Join(docs, place=place, **options).rows().where("n > 0 and doc_id is not null").select("doc_id", "place", "component"), "near-rows")
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "place")).alias("m")).select("m.place")
    return without(docs, place, rows.join(first, "place", "left_anti").select("place"))
