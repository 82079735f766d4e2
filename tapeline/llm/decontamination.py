"""Benchmark decontamination by a prefix-filtered join of word windows.

Texts are lower-cased (A-Z only) and cut into words. A window of an item is `width` consecutive words of it, or all its words
if they are fewer; a document is contaminated where a window occurs in it word by word. The join that finds them:

1. Shingles (up to SHINGLE consecutive words) of the windows are ordered by rarity: their number of occurrences in all
   documents, counted over whole texts. A window lies within a document only if its rarest shingle does, so for exact
   containment the prefix is that one shingle. A window whose rarest shingle occurs nowhere is gone before the join.
2. Documents are searched for prefix shingles only. Each occurrence carries the words around it, as far as a window that
   holds it can reach, so no text is read again.
3. Occurrences meet windows on the shingle. The shingle's place in the window fixes where the window would start; it must
   start and end inside the document (positional and length bounds).
4. What is left is verified: the document's words there equal those of the window. Hashes only ever propose.

The filter that tasks hold in memory is a bitmap of shingle hashes of a size bounded by BITS (16 MB); beyond that it lets more
occurrences through to the join, which decides in any case. The benchmark itself is never broadcast. A passage that many
documents share is a hot key of an inner join, whose large side adaptive execution splits. Items of the same words are one
class in the join; class lists become item lists once for each different list.

Null, empty and wordless texts have no words: such documents aren't contaminated, such items have no windows. Repeated
documents are judged apart by their place in the files; repeated items all count. A null item_id has no name and isn't listed,
though its windows are hits. Empty tables: no documents give no rows, no items leave every document clean. Ties in rarity go to
the smaller hash, then the earlier place. Columns beside ids and text are not read. A text of any length is one unit of work;
its words are hashed by NumPy in memory of about 50 bytes a byte of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeline.llm import texts
from tapeline.llm.common import PLACE, UPPER, LOWER, without
from tapeline.llm.exact_dedup import located
from tapeline.session import materialise

WIDTH, SHINGLE = 10, 3
#: Bits of the bitmap: PER_SHINGLE for each shingle, at most BITS.
PER_SHINGLE, BITS = 1024, 1 << 27
#: Bytes that are in no word: ASCII without digits and letters (upper-case ones are folded).
BETWEEN = np.zeros(256, bool)
BETWEEN[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = True
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


class Document:
    """The words of one text of a chunk."""

    def __init__(self, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        self.raw, self.starts, self.ends, self.hashes = raw, starts, ends, hashes

    def shingles(self, width: int) -> np.ndarray:
        """A signed 64-bit hash of each `width` consecutive words."""
        return texts.windows(self.hashes, width).view(np.int64)

    def words(self, lo: int, hi: int) -> list[str]:
        at = zip(self.starts[lo:hi].tolist(), self.ends[lo:hi].tolist(), strict=True)
        return [self.raw[a:b].translate(_FOLD).decode("utf-8", "replace") for a, b in at]


def documents(column: pa.Array) -> Iterator[Document]:
    for chunk in texts.chunks(column):
        raw = chunk.data.tobytes()
        starts, ends, first = chunk.words(BETWEEN)
        hashes = chunk.spans(starts, ends, fold=True)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            yield Document(raw, starts[a:b], ends[a:b], hashes[a:b])


def _windows(width: int, shingle: int):
    """Of each item: its class (its words' digest) and its windows, with the hashes of each window's shingles, which have as many
    words as the window has, at most `shingle`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, classes, rows, hashes = [], [], [], []
            for item, d in zip(batch.column("item_id").to_pylist(), documents(batch.column("text")), strict=True):
                size = min(width, len(d.hashes))
                each = min(shingle, size)
                all_, names = d.words(0, len(d.hashes)), d.shingles(each)
                same = hashlib.sha256(" ".join(all_).encode()).hexdigest()
                for i in range(len(all_) - size + 1 if size else 0):
                    ids.append(item)
                    classes.append(same)
                    rows.append(all_[i : i + size])
                    hashes.append(names[i : i + size - each + 1].tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(classes, pa.string()), pa.array(rows, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64()))], ["item_id", "class", "words", "shingles"]
            )

    return run


class Bitmap:
    """Which hashes may be among those asked for, by shingle width."""

    def __init__(self, shingles: DataFrame):
        """`shingles`: width, shingle. Words of 64 bits are put together by Spark; at most BITS / 64 of them a width arrive."""
        self.of: dict[int, tuple[np.ndarray, int]] = {}
        for row in shingles.groupBy("width").agg(F.count(F.lit(1)).alias("n")).collect():
            bits = min(BITS, 1 << (PER_SHINGLE * row["n"] - 1).bit_length())
            at = F.pmod(F.col("shingle"), F.lit(bits))
            words = shingles.where(F.col("width") == row["width"]).groupBy(F.shiftright(at, 6).alias("word"))
            held = words.agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(shingle, {bits}) & 63 as int))")).alias("set")).toPandas()
            table = np.zeros(bits // 64, np.uint64)
            table[held["word"].to_numpy(np.int64)] = held["set"].to_numpy(np.int64).view(np.uint64)
            self.of[row["width"]] = table, bits

    def found(self, width: int, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that may be held."""
        table, bits = self.of[width]
        at = hashes.view(np.uint64) & np.uint64(bits - 1)
        return np.flatnonzero((table[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))


def _count(bitmap):
    """Occurrences of shingles in the documents of a task: a sum for each batch, the rest by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for batch in batches:
            got = {width: [np.zeros(0, np.int64)] for width in held.of}
            for d in documents(batch.column("text")):
                for width, hashes in ((w, d.shingles(w)) for w in held.of):
                    got[width].append(hashes[held.found(width, hashes)])
            for width, hashes in got.items():
                names, n = np.unique(np.concatenate(hashes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), width), pa.int32()), pa.array(names), pa.array(n, pa.int64())], ["width", "shingle", "n"])

    return run


def _search(bitmap, width: int):
    """Of each document: its number of words, and where a prefix shingle may stand, with the words around."""
    found = pa.list_(pa.struct([("width", pa.int32()), ("shingle", pa.int64()), ("at", pa.int64()), ("from", pa.int64()), ("words", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bitmap.value
        for batch in batches:
            sizes, hits = [], []
            for d in documents(batch.column("text")):
                n, got = len(d.hashes), []
                for each in held.of:
                    reach = width - each if each == held.widest else 0  # shorter shingles are whole windows
                    hashes = d.shingles(each)
                    for at in held.found(each, hashes).tolist():
                        lo = max(0, at - reach)
                        got.append({"width": each, "shingle": int(hashes[at]), "at": at, "from": lo, "words": d.words(lo, min(n, at + each + reach))})
                sizes.append(n)
                hits.append(got)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(sizes, pa.int64()), pa.array(hits, found)], ["doc_id", "place", "n_words", "found"])

    return run


def item_windows(items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Different windows (window, words, shingles), the classes that have them (window, class), and the items of these (class,
    item_id)."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    cut = rows.mapInArrow(_windows(width, shingle), "item_id long, class string, words array<string>, shingles array<long>")
    cut = materialise(cut.withColumn("window", F.sha2(F.array_join("words", " "), 256)), "windows")
    windows = cut.groupBy("window").agg(F.any_value("words").alias("words"), F.any_value("shingles").alias("shingles"))
    return windows, cut.select("window", "class").distinct(), cut.where("item_id is not null").select("class", "item_id").distinct()


def prefixes(windows: DataFrame, docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Each window that can occur in `docs` with its rarest shingle: window, words, width, shingle, shift (the shingle's place)."""
    spark = windows.sparkSession
    width = F.least(F.size("words"), F.lit(shingle))
    parts = windows.select("window", "words", width.alias("width"), F.posexplode("shingles").alias("shift", "shingle"))
    bitmap = spark.sparkContext.broadcast(Bitmap(parts.select("width", "shingle").distinct()))
    counts = docs.select("text").mapInArrow(_count(bitmap), "width int, shingle long, n long").groupBy("width", "shingle").agg(F.sum("n").alias("n"))
    ranked = parts.join(counts, ["width", "shingle"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "shift"))
    best = ranked.groupBy("window", "words", "width").agg(rarest.alias("best")).where("best.n > 0")
    return best.select("window", "words", "width", F.col("best.shingle").alias("shingle"), F.col("best.shift").alias("shift"))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """For `docs` (doc_id, place, text): each document with its number of words; each occurrence of a window in one (place, at,
    upto: word positions, end exclusive, window); the classes of
    each window; and the items of each class."""
    spark = docs.sparkSession
    windows, classed, owners = item_windows(items, width, shingle)
    windows = materialise(prefixes(windows, docs, shingle), "prefixes")
    bitmap = Bitmap(windows.select("width", "shingle").distinct())
    bitmap.widest = shingle
    searched = docs.mapInArrow(_search(spark.sparkContext.broadcast(bitmap), width), f"doc_id long, place {PLACE}, n_words long, found array<struct<width: int, shingle: bigint, at: bigint, `from`: bigint, words: array<string>>>")
    searched = materialise(searched, "searched")
    found = searched.where(F.size("found") > 0).select("place", "n_words", F.explode("found").alias("f")).select("place", "n_words", "f.width", "f.shingle", (F.col("f.at")).alias("hit"), F.col("f.from").alias("lo"), F.col("f.words").alias("around"))
    met = found.join(windows.hint("merge"), ["width", "shingle"])
    at, size = F.col("hit") - F.col("shift"), F.size("words")
    bounded = met.where((at >= 0) & (at + size <= F.col("n_words")))  # the window must lie within the document
    verified = bounded.where(F.slice("around", (at - F.col("lo") + 1).cast("int"), size) == F.col("words"))
    return searched.select("doc_id", "place", "n_words"), verified.select("place", at.alias("at"), (at + size).alias("upto"), "window"), classed, owners


def _judged(docs: DataFrame, place: Column, items: DataFrame, width: int, shingle: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), place.alias("place"), F.col("text").cast("string").alias("text"))
    all_, found, classed, owners = occurrences(rows, items, width, shingle)
    found = materialise(found, "occurrences")
    # Words under at least one window: what each adds to those that start before it.
    before = Window.partitionBy("place").orderBy("at", "upto").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.greatest(F.lit(0), F.col("upto") - F.greatest(F.col("at"), F.coalesce(F.max("upto").over(before), F.lit(0))))
    hits = found.select("place", "at", "upto").distinct().withColumn("new", covered).groupBy("place").agg(F.sum("new").alias("n_hit"))
    # Items of the same words are one class; documents have lists of classes; each different list is spelled once.
    lists = found.select("place", "window").distinct().join(classed.hint("merge"), "window").groupBy("place").agg(F.array_sort(F.collect_set("class")).alias("list")).withColumn("key", F.sha2(F.array_join("list", ","), 256))
    lists = materialise(lists, "class-lists")
    named = lists.groupBy("key").agg(F.any_value("list").alias("list")).select("key", F.explode("list").alias("class")).join(owners.hint("merge"), "class")
    spelled = named.groupBy("key").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    with_items = lists.select("place", "key").join(spelled.hint("merge"), "key").select("place", "items")
    none = F.array().cast("array<string>")
    out = all_.join(hits, "place", "left").join(with_items, "place", "left")
    n_hit, listed = F.coalesce("n_hit", F.lit(0)).cast("long"), F.coalesce("items", none)
    return out.select(
        "doc_id", "place", "n_words", n_hit.alias("n_hit"), F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), listed.alias("items")
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (sorted as strings)."""
    docs, place = located(docs)
    return _judged(docs, place, items, width, shingle).drop("place")


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE) -> DataFrame:
    """The rows of `docs` in which no window of `items` occurs, each by itself, whatever its doc_id."""
    docs, place = located(docs)
    return without(docs, place, _judged(docs, place, items, width, shingle).where("contaminated").select("place"))
