"""Links of a file system given as a table: paths with all of them followed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeline.session import materialise

#: Rounds after which a path that still meets links is taken to run in a circle (Linux gives up after 40 links).
ROUNDS = 40
_STEPS = "array<string>"


def _steps(path: Column) -> Column:
    """The names in a path, with `..`; empty and `.` steps go."""
    return F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))


def _joined(steps: Column) -> Column:
    return F.concat(F.lit("/"), F.array_join(steps, "/"))


def _back(done: Column) -> Column:
    return F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))


def closed(links: DataFrame) -> DataFrame:
    """`links` (link, where it lies; target, as it is spelled) with chains cut short: each link's target, made absolute, is no link itself, or `loop` is true.
    Pointers jump twice as far each round, so a chain of n links takes about log2(n) rounds. A link in a circle, or leading
    into one, keeps a target in it. Of rows with one link the least target counts; rows with a null are no links."""
    steps, near = _steps(F.col("target")), _back(_steps(F.col("link")))
    up = (F.length(F.regexp_extract(_joined(steps), r"^((?:/\.\.(?=/|$))*)", 1)) / 3).cast("int")  # first steps back, in folders that are no links
    beside = F.concat(F.slice(near, F.lit(1), F.greatest(F.size(near) - up, F.lit(0))), F.slice(steps, up + 1, F.size(steps)))
    target = F.when(F.startswith("target", F.lit("/")), _joined(steps)).otherwise(_joined(beside))
    rows = links.where("link is not null and target is not null").select(_joined(_steps(F.col("link"))).alias("link"), target.alias("target"))
    rows = materialise(rows.groupBy("link").agg(F.min("target").alias("target")), "links")
    jumps, n = 0, rows.count()
    while 1 << jumps <= n:  # no chain without a circle is longer than all links
        further = rows.select(F.col("link").alias("target"), F.col("target").alias("_next"))
        rows = materialise(rows.join(further, "target", "left").select("link", F.coalesce("_next", "target").alias("target"), F.col("_next").isNotNull().alias("_moved")), "links")
        if not rows.where("_moved").limit(1).count():
            break
        jumps += 1
    ends = rows.select(F.col("link").alias("target"), F.lit(True).alias("loop"))
    return rows.select("link", "target").join(ends, "target", "left").select("link", "target", F.coalesce("loop", F.lit(False)).alias("loop"))


def resolved(paths: DataFrame, links: DataFrame, path: str = "path", base: str = "/") -> DataFrame:
    """`paths` with `resolved`, the path from the root that no link is part of, and `loop`. Links may be files or folders and
    lead anywhere; `..` goes back from where a link led, not from its name, as file systems do it. Relative paths start at
    `base`. A path that runs in a circle has a null `resolved` and `loop` true; a null path has both null.

    A round takes each path to its first link, or to its first `..`, and follows it; equal paths are followed once. Rounds end
    when all paths have arrived: as many as folders that are links, one inside the other, since chains are closed before."""
    own = F.col("_path")
    whole = F.when(F.startswith(own, F.lit("/")), own).otherwise(F.concat(F.lit(base + "/"), own))
    short = materialise(closed(links), "closed-links")
    start = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("_path")).distinct()
    start = start.select("_path", F.array().cast(_STEPS).alias("done"), _steps(whole).alias("rest"))
    going, arrived = materialise(start, "paths"), []
    empty = F.size("rest") == 0
    for _ in range(ROUNDS):
        arrived.append(going.where(empty).select("_path", _joined(F.col("done")).alias("resolved"), F.lit(False).alias("loop")))
        going = going.where(~empty)
        if not going.limit(1).count():
            break
        going = materialise(_round(going, short), "paths")
        arrived.append(going.where("loop").select("_path", F.lit(None).cast("string").alias("resolved"), "loop"))
        going = going.where("not loop").drop("loop")
    else:
        arrived.append(going.select("_path", F.lit(None).cast("string").alias("resolved"), F.lit(True).alias("loop")))
    out = arrived[0]
    for more in arrived[1:]:
        out = out.unionByName(more)
    return paths.join(out.withColumnRenamed("_path", path), path, "left").select(*paths.columns, "resolved", "loop")


def _round(going: DataFrame, links: DataFrame) -> DataFrame:
    """One step of each path: over names that are no links, then through a link or back over `..`."""
    # Names before the first `..`; each may make the path so far a link.
    ahead = F.when(F.array_position("rest", "..") > 0, (F.array_position("rest", "..") - 1).cast("int")).otherwise(F.size("rest"))
    rows = going.withColumn("ahead", ahead)
    tried = rows.where("ahead > 0").select("_path", "done", "rest", F.explode(F.sequence(F.lit(1), F.col("ahead"))).alias("taken"))
    prefix = _joined(F.concat("done", F.slice("rest", F.lit(1), F.col("taken"))))
    met = tried.select("_path", "taken", prefix.alias("link")).join(links, "link").groupBy("_path").agg(F.min(F.struct("taken", "target", "loop")).alias("hit"))
    rest_from = lambda n: F.slice("rest", n + 1, F.size("rest"))
    through = F.col("hit").isNotNull()
    passed = F.concat("done", F.slice("rest", F.lit(1), F.col("ahead")))
    back = F.col("ahead") < F.size("rest")
    done = F.when(through, F.array().cast(_STEPS)).when(back, _back(passed)).otherwise(passed)
    rest = F.when(through, F.concat(_steps(F.col("hit.target")), rest_from(F.col("hit.taken")))).when(back, rest_from(F.col("ahead") + 1)).otherwise(F.array().cast(_STEPS))
    return rows.join(met, "_path", "left").select("_path", done.alias("done"), rest.alias("rest"), F.coalesce("hit.loop", F.lit(False)).alias("loop"))
