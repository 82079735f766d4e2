"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Sizes. A document's size is its number of words (null text: 0). Sources get weights in turn, by code point, null
   last; the mix is `share` times all words. A target above `most` times its source's size is cut to that, and the
   excess is shared out again by weight, until none is above.
2. Blocks. A source is cut into blocks of about `block_words` words: a document's block is a hash of its doc_id and text, and of
   its number among rows equal in both (its key; so rows without a doc_id, or with one that many share, and equal rows are
   spread as others are), and block
   numbers are in random order already and any run of them is a permuted draw without replacement. A source's quota of
   draws is: all its blocks once per full pass, then the leading blocks that still fit its target, then a part of the
   next block: its documents from the largest down, each taken where it fits (the one that is left over last is taken
   if that brings the total nearer).
3. Tree. The quotas of all sources stand in the root. Each node gives its left child half its places, drawn from the
   sources' quotas without replacement: a multivariate hypergeometric draw, one conditional hypergeometric draw per
   source. The leaves are the output shards, and their quotas add up to the sources' exactly.
4. Shards draw disjoint runs of a source's permuted blocks, and each shard orders its rows by a hash.

Everything is a hash of the seed and of keys, so reruns agree. Only tables with a row per source, per block or per
(source, shard) are windowed or grouped by source; documents meet their block on (source, block), which spreads a source
of any size. Wide texts are not moved until rows are written. Equal rows are numbered by their place in the files, over sorted
ranges, so they may be a third of all rows; which of them has which number makes no difference to the mix.

Empty table: no rows. Null or empty texts have size 0 and are never taken by the query. Equal rows count each by itself, so a
source that is one row, again and again, meets its target too. What is collected at a time is at most one block's keys with
words, whatever the number of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeline.llm.common import WORD, every, fresh, unit
from tapeline.llm.exact_dedup import located
from tapeline.operators.ordering import with_index
from tapeline.session import materialise

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK_WORDS, SHARD_WORDS, CHUNK = 1 << 15, 1 << 22, 1024
SEED = 17
#: Rows beside the first of equal ones that are broadcast to the texts, at most (24 bytes each); more are joined.
FEW = 1 << 18


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """`sources` (source, source_size) with weight and target: one row per source, so unpartitioned windows are small."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    ranked = sources.withColumn("place", F.row_number().over(order)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    )
    # Water filling: by rising (cap / weight), a source is cut if its share of what the earlier ones leave exceeds its cap.
    cap = F.col("source_size") * F.lit(most)
    rising = Window.orderBy(F.col("fill"), F.col("place"))
    return (
        ranked.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
        .withColumn("fill", cap / F.col("weight"))
        .withColumn("left", F.col("total") - (F.sum(cap).over(rising) - cap))
        .withColumn("weights_left", F.sum("weight").over(every) - (F.sum("weight").over(rising) - F.col("weight")))
        .withColumn("level", F.col("left") / F.col("weights_left"))
        .withColumn("open", F.min(F.when(F.col("fill") > F.col("level"), F.struct("fill", "place", "level"))).over(every))
        .withColumn("target", F.when(F.col("fill") > F.col("open.level"), F.col("open.level") * F.col("weight")).otherwise(cap))
        .select("source", "source_size", "weight", F.col("target").cast("double").alias("target"))
    )


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series at n + 10, stepped down; absolute error below 1e-10 for n >= 0."""
    x = n + 10.0
    series = (x - 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    steps = n + 1.0
    for i in range(2, 10):
        steps = steps * (n + float(i))
    return series - F.ln(steps)


def hypergeometric(good: Column, bad: Column, draws: Column, u: Column) -> Column:
    """A draw by inversion: how many of `draws` taken without replacement are good. Sums eight deviations around the mean."""
    total = good + bad
    mean = draws * good / F.greatest(total, F.lit(1.0))
    spread = F.sqrt(F.greatest(mean * (bad / F.greatest(total, F.lit(1.0))) * ((total - draws) / F.greatest(total - 1, F.lit(1.0))), F.lit(0.0))) * 8 + 8
    low = F.greatest(F.lit(0.0), draws - bad, F.floor(mean - spread).cast("double"))
    high = F.least(draws, good, F.ceil(mean + spread).cast("double"))
    lf = _log_factorial
    first = F.exp(
        lf(good) - lf(low) - lf(good - low) + lf(bad) - lf(draws - low) - lf(bad - draws + low) - lf(total) + lf(draws) + lf(total - draws)
    )
    start = F.struct(first.alias("p"), F.lit(0.0).alias("cum"), low.alias("pick"))

    def step(acc: Column, k: Column) -> Column:
        cum = acc["cum"] + acc["p"]
        ratio = (good - k) * (draws - k) / ((k + 1) * (bad - draws + k + 1))
        return F.struct(
            (acc["p"] * ratio).alias("p"), cum.alias("cum"), F.when(cum < u, F.least(k + 1, high)).otherwise(acc["pick"]).alias("pick")
        )

    steps = F.transform(F.sequence(low.cast("long"), high.cast("long")), lambda k: k.cast("double"))
    return F.aggregate(steps, start, step, lambda acc: acc["pick"])


def split_tree(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """`quotas` (source_no, quota) divided among 2**depth shards: (shard, source_no, quota), level by level.

    A node is one row that holds a small struct per source."""
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("source_no", F.col("quota").cast("double").alias("quota")))).alias("q")).select(
        F.lit(0).cast("long").alias("shard"), "q"
    )
    for level in range(depth):
        total = F.aggregate("q", F.lit(0.0), lambda a, x: a + x["quota"])
        places = F.floor((total + F.pmod(F.col("shard"), F.lit(2))) / 2).cast("double")
        start = F.struct(total.alias("rest"), places.alias("places"), F.array().cast("array<double>").alias("left"))

        tag = F.lit(level)

        def draw(acc: Column, x: Column) -> Column:
            u = unit(F.lit(seed), tag, F.col("shard"), x["source_no"])  # noqa: B023
            got = hypergeometric(x["quota"], acc["rest"] - x["quota"], acc["places"], u)
            # A one-element transform names the draw, so that it is made once.
            return F.element_at(
                F.transform(
                    F.array(got),
                    lambda g: F.struct(
                        (acc["rest"] - x["quota"]).alias("rest"), (acc["places"] - g).alias("places"), F.concat(acc["left"], F.array(g)).alias("left")
                    ),
                ),
                1,
            )

        drawn = nodes.withColumn("left", F.aggregate("q", start, draw, lambda acc: acc["left"]))
        child = lambda side: F.struct(
            (F.col("shard") * 2 + side).alias("shard"),
            F.zip_with("q", "left", lambda x, g: F.struct(x["source_no"].alias("source_no"), (g if side == 0 else x["quota"] - g).alias("quota"))).alias("q"),
        )
        nodes = materialise(drawn, "mix-tree").select(F.explode(F.array(child(0), child(1))).alias("n")).select("n.*")
    return nodes.select("shard", F.explode("q").alias("x")).select("shard", "x.source_no", F.col("x.quota").cast("long").alias("quota"))


def _key(text: Column) -> Column:
    """The key of a row (doc_id, text), the first of its equals: what its draws go by."""
    return F.xxhash64("doc_id", text)


def told_apart(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """`rows` (key, place and others, a written table) without their place, with a key of its own for each of those that share
    one; and the keys of those that aren't the first of their equals, by place (None: no rows are equal)."""
    shared = materialise(rows.groupBy(F.col("key").alias("s_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("s_key"), "mix-shared")
    if shared.isEmpty():
        return rows.drop("place"), None
    held = shared.hint("merge")
    indexed = with_index(rows.join(held, F.col("key") == F.col("s_key"), "left_semi"), "key", "place", name="at")
    first = indexed.groupBy(F.col("key").alias("f_key")).agg(F.min("at").alias("first"))
    found = indexed.join(first.hint("merge"), F.col("key") == F.col("f_key"))
    later = F.col("at") > F.col("first")
    own = F.when(later, F.xxhash64("key", F.col("at") - F.col("first"))).otherwise(F.col("key"))
    found = materialise(found.withColumn("again", later).withColumn("key", own).drop("at", "f_key", "first"), "mix-equal")
    apart = rows.join(held, F.col("key") == F.col("s_key"), "left_anti").drop("place").unionByName(found.drop("place", "again"))
    return materialise(apart, "mix-sizes"), found.where("again").select(F.col("place").alias("a_place"), F.col("key").alias("a_key"))


class Mix:
    """The mix of `docs`: `placed` documents with their blocks, `draws` of the shards, and the `copies` that these draw."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED):
        self.seed, self.shard_words = seed, shard_words
        docs, place = located(docs)
        rows = materialise(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.col("text").cast("string").alias("text"), place.alias("place"))
            .select("doc_id", "source", "size", _key(F.col("text")).alias("key"), "place"), "mix-rows"
        )
        sized, self.again = told_apart(rows)
        by_source = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        numbered = by_source.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
        passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0)
        #: A row per source: target, number of blocks, full passes, words that the last pass still takes.
        self.sources = materialise(
            numbered.withColumn("blocks", F.greatest(F.ceil(F.col("source_size") / F.lit(block_words)), F.lit(1)).cast("long"))
            .withColumn("passes", passes.cast("long"))
            .withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")),
            "mix-sources",
        )
        self.placed = self._place(sized)
        self._last_pass()

    def _place(self, rows: DataFrame) -> DataFrame:
        """`rows` (key, source, size and others) with the block of each and the figures of its source."""
        figures = self.sources.select(F.col("source").alias("s"), "source_no", "blocks", "source_size", "target", "passes", (F.col("rest") > 0).alias("open"))
        placed = rows.join(figures, rows.source.eqNullSafe(F.col("s"))).withColumn("block", F.pmod(F.xxhash64(F.lit(self.seed), "key"), F.col("blocks")))
        return placed.drop("s", "blocks")

    def _last_pass(self) -> None:
        """Which blocks the last pass takes whole, and which documents of the next block."""
        sums = materialise(self.placed.groupBy("source_no", "block").agg(F.sum("size").alias("words")), "mix-blocks")
        rests = self.sources.select("source_no", "rest")
        # Prefix sums in two steps: over chunks of blocks, then inside the one chunk where the rest runs out.
        chunk = F.floor(F.col("block") / CHUNK)
        chunks = sums.groupBy("source_no", chunk.alias("chunk")).agg(F.sum("words").alias("words"))
        in_order = Window.partitionBy("source_no").orderBy("chunk")
        edge = (
            chunks.withColumn("upto", F.sum("words").over(in_order)).join(rests, "source_no").where("upto > rest")
            .groupBy("source_no").agg(F.min(F.struct("chunk", "upto", "words", "rest")).alias("e"))
            .select("source_no", F.col("e.chunk").alias("chunk"), (F.col("e.upto") - F.col("e.words")).alias("before"), F.col("e.rest").alias("rest"))
        )
        inside = Window.partitionBy("source_no").orderBy("block")
        self.edge = materialise(
            sums.withColumn("chunk", chunk).join(edge, ["source_no", "chunk"])
            .withColumn("upto", F.col("before") + F.sum("words").over(inside)).where("upto > rest")
            .groupBy("source_no").agg(F.min(F.struct("block", "upto", "words", "rest")).alias("e"))
            .select("source_no", F.col("e.block").alias("edge_block"), (F.col("e.rest") - (F.col("e.upto") - F.col("e.words"))).alias("room")),
            "mix-edge",
        )
        in_edge = self.placed.where("size > 0").join(self.edge, "source_no").where("block = edge_block")
        keys = in_edge.groupBy("source_no", "key").agg(F.sum("size").alias("size"), F.first("room").alias("room"))
        filled = keys.groupBy("source_no").agg(
            F.sort_array(F.collect_list(F.struct("size", "key")), asc=False).alias("xs"), F.first("room").alias("room")
        )
        start = F.struct(F.col("room").alias("room"), F.array().cast("array<bigint>").alias("keys"), F.lit(None).cast("struct<size:bigint,key:bigint>").alias("small"))

        def fit(acc: Column, x: Column) -> Column:
            fits = x["size"] <= acc["room"]
            return F.struct(
                F.when(fits, acc["room"] - x["size"]).otherwise(acc["room"]).alias("room"),
                F.when(fits, F.concat(acc["keys"], F.array(x["key"]))).otherwise(acc["keys"]).alias("keys"),
                F.when(~fits, x).otherwise(acc["small"]).alias("small"),
            )

        def close(acc: Column) -> Column:
            nearer = acc["small"].isNotNull() & (acc["small"]["size"] < 2 * acc["room"])
            return F.when(nearer, F.concat(acc["keys"], F.array(acc["small"]["key"]))).otherwise(acc["keys"])

        self.parts = materialise(
            filled.select("source_no", F.explode(F.aggregate("xs", start, fit, close)).alias("key")), "mix-parts"
        )

    def taken(self, placed: DataFrame | None = None) -> DataFrame:
        """Placed rows with `takes`: how often the mix takes each."""
        edge = self.edge.select(F.col("source_no").alias("e_no"), "edge_block")
        part = self.parts.select(F.col("source_no").alias("p_no"), F.col("key").alias("p_key"))
        placed = self.placed if placed is None else placed
        joined = placed.join(edge, F.col("source_no") == F.col("e_no"), "left").join(
            part, (F.col("source_no") == F.col("p_no")) & (F.col("key") == F.col("p_key")) & (F.col("block") == F.col("edge_block")), "left"
        )
        whole = F.col("edge_block").isNull() | (F.col("block") < F.col("edge_block"))
        once = F.col("open") & (whole | F.col("p_no").isNotNull())
        takes = F.when(F.col("size") > 0, F.col("passes") + once.cast("long")).otherwise(0)
        return joined.withColumn("takes", takes).drop("e_no", "edge_block", "p_no", "p_key")

    def draws(self) -> DataFrame:
        """The tree's outcome: (source_no, shard, lo, hi), the run [lo, hi) of a source's draws that a shard gets. Draw i is
        block i mod blocks, in pass i div blocks; the last may be a part of its block."""
        last = F.when(F.col("rest") <= 0, F.lit(0)).otherwise(F.coalesce(F.col("edge_block") + 1, F.col("blocks")))
        quotas = self.sources.join(self.edge, "source_no", "left").select("source_no", (F.col("passes") * F.col("blocks") + last).alias("quota"))
        words = self.sources.agg(F.sum("target")).first()[0] or 0.0
        depth = max(0, math.ceil(math.log2(max(1.0, words / self.shard_words))))
        run = Window.partitionBy("source_no").orderBy("shard")
        return (
            materialise(split_tree(quotas, depth, self.seed), "mix-quotas").withColumn("hi", F.sum("quota").over(run))
            .select("source_no", "shard", (F.col("hi") - F.col("quota")).alias("lo"), "hi").where("hi > lo")
        )

    def copies(self, placed: DataFrame | None = None) -> DataFrame:
        """A row for every copy that the shards draw: the placed row, its pass, shard, and order inside the shard."""
        runs = self.draws().join(self.sources.select("source_no", "blocks"), "source_no")
        # A run touches few passes; each gives the piece of blocks that it covers there.
        pieces = (
            runs.withColumn("pass", F.explode(F.sequence(F.floor(F.col("lo") / F.col("blocks")), F.floor((F.col("hi") - 1) / F.col("blocks")))))
            .withColumn("from", F.greatest(F.col("lo") - F.col("pass") * F.col("blocks"), F.lit(0)))
            .withColumn("to", F.least(F.col("hi") - F.col("pass") * F.col("blocks"), F.col("blocks")))
            .select(F.col("source_no").alias("d_no"), "shard", F.col("pass").alias("d_pass"), F.explode(F.sequence(F.col("from"), F.col("to") - 1)).alias("d_block"))
        )
        pieces = materialise(pieces, "mix-draws")
        each = self.taken(placed).where("takes > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("takes") - 1)))
        drawn = each.join(pieces, (F.col("source_no") == F.col("d_no")) & (F.col("block") == F.col("d_block")) & (F.col("pass") == F.col("d_pass")))
        return drawn.drop("d_no", "d_block", "d_pass").withColumn("order_in_shard", F.xxhash64(F.lit(self.seed), "shard", "key", "pass"))


def mix_summary(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken per document, from the copies that the shards drew."""
    made = Mix(docs, **options)
    counts = made.copies().groupBy("source_no", "key").agg(F.countDistinct("pass").alias("n"))
    counts = counts.select(F.col("source_no").alias("c_no"), F.col("key").alias("c_key"), "n")
    joined = made.placed.join(counts, (F.col("source_no") == F.col("c_no")) & (F.col("key") == F.col("c_key")), "left")
    return joined.select("doc_id", "size", "source_size", "target", (F.coalesce("n", F.lit(0)) * F.col("size")).alias("taken"))


def mix(docs: DataFrame, slices: int = 4, **options) -> DataFrame:
    """The mix itself: the columns of `docs`, each row as often as it was taken, shard by shard in local order.

    Draws are joined to the rows by block, so texts are moved once, to their shard (dealt in `slices` of its order)."""
    docs, place = located(docs)
    made = Mix(docs, **options)
    name = fresh(docs, "row")
    rows = docs.select(
        F.struct(*every(docs)).alias(name), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), place.alias("place")
    ).select(F.col(name).alias("row"), "source", F.coalesce(F.col("text").rlike(WORD), F.lit(False)).cast("long").alias("size"), _key(F.col("text")).alias("key"), "place")
    if made.again is not None:
        few = made.again.limit(FEW + 1).count() <= FEW
        again = F.broadcast(made.again) if few else made.again.hint("merge")
        rows = rows.join(again, F.col("place") == F.col("a_place"), "left").withColumn("key", F.coalesce("a_key", "key")).drop("a_place", "a_key")
    rows = rows.drop("place")
    copies = made.copies(made._place(rows)).select("row", "shard", "order_in_shard", F.pmod("order_in_shard", F.lit(slices)).alias("slice"))
    return copies.repartition("shard", "slice").sortWithinPartitions("shard", "slice", "order_in_shard").select("row.*")
