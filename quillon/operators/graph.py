"""Traversal of the weighted graph: impact with paths, reachability, fan-out caps, closures, neighbourhoods.

Impact goes level by level from the front: the edges of the front's nodes are picked first, of these the far ends that live, of these
the best of each node, so what a step costs follows the front and not the table. A node's arrival counts if its score, the product of weight
times confidence along the way, is above all it had at earlier levels; only such arrivals are followed, as a weaker one can't improve anything behind
it. Each level keeps its arrivals with their predecessors, and paths are put together backwards from the best arrivals. The loop on the driver sees
row counts only and ends when nothing is left to follow; its tables are deleted when the result is written.

Edge cases: cycles and loops end by the depth; seeds never are results, but are walked from even if deleted; seeds without edges give no rows; of equal
arrivals the one from the first node by name and then of the first edge type counts, and of equal scores at two levels the shorter way; a null
confidence or a type without weight is followed by no one; without ``symbols`` every end counts as live.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import is_test
from .settle import released, settled, sized

# Edge types that a change of a body travels along, those that cross between services, and what each type weighs.
BODY = ("reads", "writes", "persists", "emits", "calls", "calls_graphql", "calls_http")
SEAM = ("calls_graphql", "calls_http")
WEIGHTS = {"calls": 0.9, "implements": 0.85, "extends": 0.85, "injects": 0.8, "calls_graphql": 0.85, "calls_http": 0.85, "routes": 0.7, "persists": 0.7, "renders": 0.65, "reads": 0.6, "writes": 0.6, "emits": 0.6, "tests": 0.5, "imports": 0.3}
DEPTH, FLOOR, FAN_OUT = 5, 0.15, 200


def thousandths(x):
    """Rounded half up to three decimals, the same in every engine."""
    return F.floor(x * 1000 + 0.5) / 1000


def live_names(symbols: DataFrame) -> DataFrame:
    """``fqn`` of the symbols that live, once each."""
    there = symbols.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in symbols.columns else symbols
    return there.select("fqn").where("fqn IS NOT NULL").distinct()


def live_edges(edges: DataFrame, symbols: DataFrame, *ends: str) -> DataFrame:
    """The edges of which the named ends (``src``, ``dst``) live."""
    for end in ends:
        edges = edges.join(live_names(symbols).withColumnRenamed("fqn", end), end, "left_semi")
    return edges


def weighted(edges: DataFrame, reverse: bool = True) -> DataFrame:
    """``node, next, edge_type, confidence, weight, score`` in the direction of travel, and ``resolution`` if edges have one."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    weight = F.element_at(F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))]), F.col("edge_type"))
    more = ["resolution"] if "resolution" in edges.columns else []
    return edges.select(F.col(a).alias("node"), F.col(b).alias("next"), "edge_type", "confidence", *more, weight.alias("weight"), (weight * F.col("confidence")).alias("score"))


def capped(steps: DataFrame, cap: int = FAN_OUT) -> DataFrame:
    """The ``cap`` neighbours of highest confidence of each node; ties by name and edge type."""
    best = Window.partitionBy("node").orderBy(F.desc("confidence"), "next", "edge_type")
    return steps.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= cap).drop("rank")


@dataclass
class Impact:
    """``reached``: fqn, score, depth, min_confidence, path; ``truncated``: fqn, depth, edges of nodes that had more than the cap; ``crossed``: how many arrivals came over a seam."""

    reached: DataFrame
    truncated: DataFrame
    crossed: int


HOP = "array<struct<from: string, edge: string, resolution: string, confidence: double>>"


def traverse(edges: DataFrame, seeds: DataFrame, symbols: DataFrame | None = None, reverse: bool = True, depth: int = DEPTH, floor: float = FLOOR, cap: int = FAN_OUT, body_only: bool = False, paths: bool = True) -> Impact:
    """What the seeds (``fqn``) reach, with the best way to each node.

    ``edges``: src, dst, edge_type, confidence and maybe resolution; ``symbols``: fqn and maybe deleted, of which the far end of a step must be
    one. ``body_only`` drops other edges at the first level, before the cap. The path's hops are in order from a seed; ``min_confidence``
    is the least along it.
    """
    spark = edges.sparkSession
    steps = weighted(edges, reverse)
    if "resolution" not in steps.columns:
        steps = steps.withColumn("resolution", F.lit(None).cast("string"))
    there = None if symbols is None else live_names(symbols).withColumnRenamed("fqn", "next")
    origin, _ = sized(seeds.select(F.col("fqn").alias("seed")).where("seed IS NOT NULL").distinct())
    front, n = sized(origin.select(F.col("seed").alias("node"), F.lit(1.0).alias("at"), F.lit(1.0).alias("least")))
    first, arrivals, over = front, [], []
    for level in range(1, depth + 1):
        if not n:
            break
        mine = steps.join(front.select("node", "at", "least"), "node")
        if body_only and level == 1:
            mine = mine.where(F.col("edge_type").isin(*BODY))
        if there is not None:
            mine = mine.join(there, "next", "left_semi")
        mine = settled(mine)
        sizes, many = sized(mine.groupBy("node").agg(F.count(F.lit(1)).alias("edges")).where(F.col("edges") > cap).select(F.col("node").alias("fqn"), F.lit(level).alias("depth"), "edges"))
        over.append(sizes)
        arrived = (capped(mine, cap) if many else mine).withColumn("s", F.col("at") * F.col("weight") * F.col("confidence")).where(F.col("s") >= floor)
        arrived = arrived.join(origin, F.col("next") == F.col("seed"), "left_anti")
        way = F.struct((-F.col("s")).alias("s"), F.col("node").alias("prev"), "edge_type", (-F.col("confidence")).alias("c"), "resolution", "least")
        new = arrived.groupBy("next").agg(F.min(way).alias("w"))
        new = new.select(F.col("next").alias("node"), (-F.col("w.s")).alias("at"), F.col("w.prev").alias("prev"), F.col("w.edge_type").alias("edge_type"), (-F.col("w.c")).alias("confidence"), F.col("w.resolution").alias("resolution"), F.least("w.least", -F.col("w.c")).alias("least"), F.lit(level).alias("depth"))
        if arrivals:
            had = _together(arrivals).groupBy("node").agg(F.max("at").alias("had"))
            new = new.join(had, "node", "left").where("had IS NULL OR at > had").drop("had")
        front, n = sized(new)
        released(mine)
        arrivals.append(front)
    if not arrivals:
        released(origin, first)
        empty = spark.createDataFrame([], f"fqn string, score double, depth int, min_confidence double, path {HOP}")
        return Impact(empty, spark.createDataFrame([], "fqn string, depth int, edges long"), 0)
    # an arrival is above all before it, so a node's last is its best
    every = _together(arrivals)
    crossed = every.where(F.col("edge_type").isin(*SEAM)).count()
    last = every.groupBy("node").agg(F.max_by(F.struct("at", "depth", "least"), "depth").alias("b"))
    found = last.select(F.col("node").alias("fqn"), F.col("b.at").alias("score"), F.col("b.depth").alias("depth"), F.col("b.least").alias("min_confidence"))
    if paths:
        # backwards: the arrival at the best level, then at each level before it that of its predecessor
        back = found.withColumn("path", F.array().cast(HOP)).withColumn("here", F.col("fqn"))
        for level in range(len(arrivals), 0, -1):
            hop = arrivals[level - 1].select(F.col("node").alias("here"), "prev", F.array(F.struct(F.col("prev").alias("from"), F.col("edge_type").alias("edge"), "resolution", "confidence")).alias("hop"))
            moved = back.where(F.col("depth") >= level).join(hop, "here").select("fqn", "score", "depth", "min_confidence", F.concat("hop", "path").alias("path"), F.col("prev").alias("here"))
            back = back.where(F.col("depth") < level).unionByName(moved)
        found = back.drop("here")
    reached = settled(found)
    released(origin, first, *arrivals)
    return Impact(reached, _together(over), crossed)


def _together(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for x in tables[1:]:
        out = out.unionByName(x)
    return out


def impact(edges: DataFrame, seeds: DataFrame, symbols: DataFrame | None = None, reverse: bool = True, depth: int = DEPTH, floor: float = FLOOR, cap: int = FAN_OUT, body_only: bool = False) -> DataFrame:
    """``fqn, score, depth`` of ``traverse``, the score rounded, without paths."""
    found = traverse(edges, seeds, symbols, reverse, depth, floor, cap, body_only, paths=False).reached
    return found.select("fqn", thousandths(F.col("score")).alias("score"), "depth")


def path_text(path: Column) -> Column:
    """A path on one line: ``name -edge-> name -edge->``, up to the node that it leads to."""
    return F.array_join(F.transform(path, lambda h: F.concat(h["from"], F.lit(" -"), h["edge"], F.lit("-> "))), "")


def report(reached: DataFrame, symbols: DataFrame, limit: int = 50, reverse: bool = True) -> DataFrame:
    """``fqn, kind, file_path, start_line, score, depth, test, uncovered`` of what ``impact`` reached.

    Tests are split off first and all stay; of the rest the ``limit`` best by score and then name. ``uncovered`` says of the whole report
    that, upstream, something is reached but no test. What is no symbol is left out; nothing reached gives no rows.
    """
    slim = symbols.groupBy("fqn").agg(F.min(F.struct("kind", "file_path", "start_line")).alias("s"))
    rows = settled(reached.join(slim, "fqn").select("fqn", "s.*", "score", "depth").withColumn("test", is_test(F.col("file_path"), F.col("fqn"))))
    best = rows.where("NOT test").orderBy(F.desc("score"), "fqn").limit(limit)
    bare = rows.agg((F.lit(reverse) & (F.count_if("test") == 0) & (F.count(F.lit(1)) > 0)).alias("uncovered"))
    return rows.where("test").unionByName(best).crossJoin(F.broadcast(bare))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int, symbols: DataFrame | None = None, reverse: bool = True) -> DataFrame:
    """``fqn, depth`` of every node within so many steps, without weights; a node met before isn't left again, and with ``symbols`` only live ones are met."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    steps = edges.select(F.col(a).alias("node"), F.col(b).alias("next"))
    there = None if symbols is None else live_names(symbols).withColumnRenamed("fqn", "node")
    front, n = sized(seeds.select(F.col("fqn").alias("node")).distinct())
    met = front.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        if not n:
            break
        moved = steps.join(front, "node").select(F.col("next").alias("node")).distinct().join(met, "node", "left_anti")
        front, n = sized(moved if there is None else moved.join(there, "node", "left_semi"))
        met = met.unionByName(front.withColumn("depth", F.lit(level)))
    return met.where("depth > 0").select(F.col("node").alias("fqn"), "depth")


def both_ways(edges: DataFrame, seeds: DataFrame, symbols: DataFrame | None = None, **how) -> DataFrame:
    """``fqn, score`` of impact in both directions, each node with its better score."""
    either = impact(edges, seeds, symbols, True, **how).unionByName(impact(edges, seeds, symbols, False, **how))
    return either.groupBy("fqn").agg(F.max("score").alias("score"))


# The way that an intent's question goes; others go both ways.
WAYS = {"refactor": "reverse", "review": "reverse", "build": "reverse", "debug": "forward"}


def expand(edges: DataFrame, seeds: DataFrame, intent: str, symbols: DataFrame | None = None, **how) -> Impact:
    """Impact in the direction that an intent asks for; what both directions reach counts once, with its better way, the one from dependents on ties."""
    way = WAYS.get(intent, "both")
    if way != "both":
        return traverse(edges, seeds, symbols, reverse=way == "reverse", **how)
    a, b = traverse(edges, seeds, symbols, True, **how), traverse(edges, seeds, symbols, False, **how)
    rows = a.reached.withColumn("second", F.lit(0)).unionByName(b.reached.withColumn("second", F.lit(1)))
    cols = [c for c in rows.columns if c != "fqn"]
    one = rows.groupBy("fqn").agg(F.min_by(F.struct(*cols), F.struct(-F.round("score", 3), "second")).alias("x")).select("fqn", *[f"x.{c}" for c in cols if c != "second"])
    return Impact(one, a.truncated.unionByName(b.truncated), a.crossed + b.crossed)


def ancestors(start: DataFrame, pairs: DataFrame, depth: int = 8) -> DataFrame:
    """``fqn, ancestor, depth`` above each start (``fqn``) by pairs ``fqn, ancestor``, within so many steps, each by its shortest way."""
    step = pairs.select(F.col("fqn").alias("of"), F.col("ancestor").alias("up")).where("of IS NOT NULL AND up IS NOT NULL")
    front, n = sized(start.select("fqn").distinct().join(step, F.col("fqn") == F.col("of")).select("fqn", F.col("up").alias("ancestor")).distinct())
    out = front.withColumn("depth", F.lit(1))
    for level in range(2, depth + 1):
        if not n:
            break
        moved = front.join(step, F.col("ancestor") == F.col("of")).select("fqn", F.col("up").alias("ancestor")).distinct()
        front, n = sized(moved.join(out, ["fqn", "ancestor"], "left_anti"))
        out = out.unionByName(front.withColumn("depth", F.lit(level)))
    return out


def closure(pairs: DataFrame, depth: int = 8) -> DataFrame:
    """``fqn, ancestor, depth`` of pairs ``fqn, ancestor``: all ancestors of every name."""
    declared = settled(pairs.select("fqn", "ancestor").distinct())
    return ancestors(declared, declared, depth)


def supertypes(edges: DataFrame, depth: int = 8) -> DataFrame:
    """``fqn, ancestor, depth``: the closure of extends and implements."""
    return closure(edges.where(F.col("edge_type").isin("extends", "implements")).select(F.col("src").alias("fqn"), F.col("dst").alias("ancestor")), depth)
