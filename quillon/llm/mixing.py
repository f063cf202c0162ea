"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

Each source gets a target in words; each of its documents the same copy rate (target over size), of which the whole part
is taken at once. The fractional parts are rounded dependently: two documents at a time, mass (words) moves from one to
the other in a random direction, weighted so that the expectation stays, until one of them is at 0 or 1. The sum of
words stays exact through every step, so a source misses its target by less than one document. Steps are folded over
blocks of a bounded number of documents; what is left of each block goes to the next level, so that a source of any
size is a tree of small folds over all executors. Draws are hashes of the documents, so reruns agree.

Edge cases: a null or empty text has size 0 and is taken 0 times; a source whose texts are all empty has target 0; null
sources come last in order and are a source of their own; repeated rows (same id, source and text) are one unit, of
whose copies only the last one's fraction is rounded, and which its rows share, none with more than one copy above another; null ids are ids like others; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Documents that one fold takes at most, about.
BLOCK = 200
#: Weights of the sources in the order of their code points, and the share of all words that is shared out.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source, source_size, target``: shares by weight, none above ``most`` times its source's size.

    Sharing the excess again and again ends at min(most * size, level * weight) with one level for all, which sums
    over the sources in order of size by weight give directly. One row per source goes through one task here.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (n % len(weights) + 1).cast("int"))
    one = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    below = everything.rowsBetween(Window.unboundedPreceding, -1)
    rest = everything.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    total = F.sum("source_size").over(whole) * share
    # if all before this one are at their caps, the level that shares the rest among the others
    level = (total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest)
    staged = one.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    final = staged.withColumn("level", F.max("level").over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return final.select("source", "source_size", target.alias("target"))


def uniform(*of: Column) -> Column:
    """A number in [0, 1) by hashing."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def folded(items: Column, level: int, kind: str) -> Column:
    """A fold over an array of ``key, size, mass`` (mass: probability times size): settled ones, and the one left."""
    settled_type = f"array<struct<key:{kind},one:boolean>>"
    start = F.struct(items[0].alias("left"), F.array().cast(settled_type).alias("done"))

    def step(acc: Column, x: Column) -> Column:
        r = acc["left"]
        up, down = r["size"] - r["mass"], r["mass"]  # room above and below, in words
        to_r, to_x = F.least(up, x["mass"]), F.least(down, x["size"] - x["mass"])
        first = uniform(r["key"], x["key"], F.lit(level)) * (to_r + to_x) < to_x  # mass goes to r, as likely as the other way would move
        first = first | (to_r + to_x <= 0)

        def item(y: Column, mass: Column) -> Column:
            return F.struct(y["key"].alias("key"), y["size"].alias("size"), mass.alias("mass"))

        def result(left: Column, gone: Column, one: bool) -> Column:
            return F.struct(left.alias("left"), F.array_append(acc["done"], F.struct(gone["key"].alias("key"), F.lit(one).alias("one"))).alias("done"))

        give = F.when(up <= x["mass"], result(item(x, x["mass"] - up), r, True)).otherwise(result(item(r, r["mass"] + x["mass"]), x, False))
        room = x["size"] - x["mass"]
        take = F.when(down <= room, result(item(x, x["mass"] + down), r, False)).otherwise(result(item(r, r["mass"] - room), x, True))
        return F.when(first, give).otherwise(take)

    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def rounded(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """``key, one``: whether the fractional part of each of ``key, source, size, mass`` is rounded up.

    ``key`` is unique and 0 < mass < size. A small job per level finds how many blocks there are; no rows come to the
    driver, and each level's blocks are written to the shared folder, so a lost executor costs one level's tasks at most.
    """
    kind = parts.schema["key"].dataType.simpleString()
    state = parts.select("source", F.struct("key", F.col("size").cast("double").alias("size"), "mass").alias("x"))
    settled, level = [], 0
    while True:
        n = state.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        last = n <= block
        by = F.pmod(F.xxhash64(F.col("x.key"), F.lit(f"block{level}")), F.lit(1 if last else -(-n // (block // 2))))
        # large ones first, so that what is left at the end is small
        listed = F.sort_array(F.collect_list(F.struct((-F.col("x.size")).alias("o"), F.xxhash64("x.key").alias("h"), "x")), True)
        done = cut(state.groupBy("source", by.alias("block")).agg(F.transform(listed, lambda y: y["x"]).alias("items")).select("source", folded(F.col("items"), level, kind).alias("f")))
        settled.append(done.select(F.explode("f.done").alias("d")).select("d.key", "d.one"))
        left = done.select("source", F.col("f.left").alias("x"))
        if last:  # of a source's last one the nearer end
            settled.append(left.select("x.key", (2 * F.col("x.mass") >= F.col("x.size")).alias("one")))
            break
        state, level = left, level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out


def mixed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, source, body, size, repeats, source_size, target, copies`` of every distinct row.

    Rows are distinct by id, source and hash of the text (``body``); the ``repeats`` together are taken ``copies`` times.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.xxhash64(F.col(text)).alias("body"), words(F.col(text)).alias("size"))
    units = cut(slim.groupBy("doc_id", "source", "body", "size").agg(F.count(F.lit(1)).alias("repeats")))
    goal = cut(targets(units.select("source", (F.col("size") * F.col("repeats")).alias("size"))))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(F.col("source").alias("__source"), "source_size", "target", rate.alias("rate"))
    goal = F.broadcast(goal) if goal.count() <= 10_000 else goal

    def aimed(rows: DataFrame) -> DataFrame:
        wanted = F.col("rate") * F.col("repeats")
        whole = F.floor(wanted + F.lit(1e-12))
        near = rows.join(goal, rows["source"].eqNullSafe(F.col("__source"))).drop("__source")
        return near.withColumns({"whole": whole.cast("long"), "part": F.greatest(wanted - whole, F.lit(0.0))})

    parts = aimed(units)
    open_ = (F.col("size") > 0) & (F.col("part") > 0)
    key = F.struct("doc_id", "source", "body", "size", "repeats").alias("key")
    one = rounded(parts.where(open_).select(key, "source", "size", (F.col("part") * F.col("size")).alias("mass")))
    back = aimed(one.select("key.*", F.col("one").cast("long").alias("one")))
    rest = parts.where(~open_).withColumn("one", F.lit(0).cast("long"))
    cols = ["doc_id", "source", "body", "size", "repeats", "source_size", "target", F.when(F.col("size") > 0, F.col("whole") + F.col("one")).otherwise(F.lit(0).cast("long")).alias("copies")]
    return back.select(*cols).unionByName(rest.select(*cols))


def share(copies: str, repeats: str, i: Column) -> Column:
    """How many of a unit's copies the i-th of its repeated rows gets, from 1."""
    return F.expr(f"{copies} div {repeats}") + (i <= F.col(copies) % F.col(repeats)).cast("long")


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""

    def unit(i: Column, s: Column, body: Column) -> Column:
        return F.struct(i.alias("i"), s.alias("s"), body.alias("b")).alias("__unit")  # equal structs have nulls at the same places

    n = mixed(docs, text, doc_id, source).where("copies > 0").select(unit(F.col("doc_id"), F.col("source"), F.col("body")), "copies", "repeats")
    n = n.select(F.col("__unit"), F.struct("copies", "repeats").alias("__n"))
    # of one type on both sides: a cast in the join's key would have the window's rows moved again
    own = unit(F.col(f"`{doc_id}`"), F.col(f"`{source}`"), F.xxhash64(F.col(f"`{text}`"))).cast(n.schema["__unit"].dataType)
    rows = docs.withColumn("__unit", own).join(n, "__unit")
    i = F.row_number().over(Window.partitionBy("__unit").orderBy("__unit"))
    rows = rows.withColumn("__copies", share("__n.copies", "__n.repeats", i).cast("int")).where("__copies > 0")
    return rows.withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))
    return mixed(docs).withColumn("__again", each).select("doc_id", "size", "source_size", "target", (share("copies", "repeats", F.col("__again")) * F.col("size")).alias("taken"))
