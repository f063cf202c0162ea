"""Review rules and detectors over the code model: each takes tables and gives the rows that a finding would be made of.

``symbols``: fqn, kind, parent_fqn, file_path and, for the annotation rules, visibility, annotations. ``changed``: fqn, kind of
API_CHANGED, API_AND_BODY_CHANGED, CONTRACT_CHANGED, BODY_CHANGED, ADDED, DELETED, RENAMED. ``edges``: src, dst, edge_type.

Edge cases: null annotations are none; a null visibility is package-private; a symbol without an owner is in no bean; a changed name
that is no symbol gives nothing; edges to themselves are followed like others but a symbol is never its own dependent; empty tables
give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_frontend, is_test
from .settle import FEW_NUMBERS, released, settled, sized

# What marks a bean, what starts a transaction, how far rules look, and how many stale callers are many.
BEANS, TRANSACTIONAL = ("Service", "Component", "Repository", "Controller", "RestController"), "Transactional"
SEAM_DEPTH, COVERAGE_DEPTH, MANY = 5, 4, 3
SIGNATURES, CONTRACTS = ("API_CHANGED", "API_AND_BODY_CHANGED"), ("API_CHANGED", "API_AND_BODY_CHANGED", "CONTRACT_CHANGED")


def has_annotation(annotations: Column, name: str) -> Column:
    """Whether an annotation of this name is there, with arguments or without, with ``@`` or without."""
    bare = lambda a: F.regexp_replace(a, "^@+", "")
    return F.coalesce(F.exists(annotations, lambda a: (bare(a) == name) | bare(a).startswith(f"{name}(")), F.lit(False))


def beans(symbols: DataFrame) -> DataFrame:
    """``owner``: symbols that a container makes."""
    marked = F.lit(False)
    for name in BEANS:
        marked = marked | has_annotation(F.col("annotations"), name)
    return symbols.where(marked).select(F.col("fqn").alias("owner")).distinct()


def transactional_non_public(symbols: DataFrame) -> DataFrame:
    """``fqn, visibility`` of methods of beans whose transaction never starts, as they aren't public."""
    seen = F.coalesce("visibility", F.lit("package-private"))
    mine = symbols.where((F.col("kind") == "method") & has_annotation(F.col("annotations"), TRANSACTIONAL) & (seen != "public"))
    return mine.join(beans(symbols), F.col("parent_fqn") == F.col("owner"), "left_semi").select("fqn", seen.alias("visibility"))


def self_invocation(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``src, dst``: calls inside a bean from outside a transaction to a method that should start one."""
    slim = symbols.select("fqn", F.col("parent_fqn").alias("parent"), has_annotation(F.col("annotations"), TRANSACTIONAL).alias("tx")).where("parent IS NOT NULL")
    inside = slim.join(beans(symbols), F.col("parent") == F.col("owner"), "left_semi")
    a = inside.where("NOT tx").select(F.col("fqn").alias("src"), F.col("parent").alias("pa"))
    b = inside.where("tx").select(F.col("fqn").alias("dst"), F.col("parent").alias("pb"))
    calls = edges.where("edge_type = 'calls' AND src <> dst").select("src", "dst").distinct()
    return calls.join(b, "dst").join(a, "src").where("pa = pb").select("src", "dst")


def orphan_operations(symbols: DataFrame, unresolved: DataFrame) -> DataFrame:
    """``src, field``: unresolved GraphQL hints (``src, hint``) of a project that serves any field at all."""
    served = symbols.where(F.col("fqn").startswith("graphql:") & ~F.col("fqn").startswith("graphql:op:") & (F.col("kind") == "route")).limit(1).select(F.lit(1).alias("__any"))
    own = unresolved.where(F.col("hint").startswith("graphql:") & ~F.col("hint").startswith("graphql:op:"))
    return own.join(symbols.select(F.col("fqn").alias("src")).distinct(), "src", "left_semi").crossJoin(F.broadcast(served)).select("src", F.regexp_replace("hint", "^(?:graphql:)+", "").alias("field")).distinct()


def number(name: Column) -> Column:
    return F.when(name.isNotNull(), F.xxhash64(name))


def reached_by(edges: DataFrame, seeds: DataFrame, depth: int, known: DataFrame):
    """``seed, node, depth`` as ``dependents``, by the keys of names, and what gives a name's key.

    A key is the name's 64-bit number, so that pairs are of two numbers and not of two names; if two of all names (of edges, seeds and ``known``) share
    one, which is counted, it is the name itself.
    """
    ends = settled(edges.where("src <> dst").select("src", "dst"))
    names = ends.select(F.explode(F.array("src", "dst")).alias("fqn")).unionByName(seeds.select("fqn")).unionByName(known.select("fqn"))
    shared = names.groupBy(number(F.col("fqn")).alias("k")).agg(F.min("fqn").alias("a"), F.max("fqn").alias("b")).where("a <> b")
    key = number if shared.isEmpty() else (lambda name: name)
    steps = settled(ends.select(key(F.col("dst")).alias("node"), key(F.col("src")).alias("next")).distinct())
    released(ends)
    front, n = sized(seeds.where("fqn IS NOT NULL").select(key(F.col("fqn")).alias("seed"), key(F.col("fqn")).alias("node")).distinct(), FEW_NUMBERS)
    met = front.withColumn("depth", F.lit(0))
    for level in range(1, depth + 1):
        if not n:
            break
        moved = front.join(steps, "node").select("seed", F.col("next").alias("node")).distinct()
        front, n = sized(moved.join(met, ["seed", "node"], "left_anti"), FEW_NUMBERS)
        met = met.unionByName(front.withColumn("depth", F.lit(level)))
    released(steps)
    return met.where("depth > 0"), key


def stale_callers(symbols: DataFrame, edges: DataFrame, changed: DataFrame, many: int = MANY) -> DataFrame:
    """``fqn, callers``: symbols of changed signature of which so many direct dependents haven't changed."""
    seeds = changed.where(F.col("kind").isin(*SIGNATURES)).select("fqn").distinct().join(symbols.select("fqn").distinct(), "fqn", "left_semi")
    pairs = edges.select("src", "dst").distinct().join(seeds.select(F.col("fqn").alias("dst")), "dst", "left_semi")
    still = pairs.join(changed.select(F.col("fqn").alias("src")).distinct(), "src", "left_anti")
    return still.groupBy(F.col("dst").alias("fqn")).agg(F.count(F.lit(1)).alias("callers")).where(F.col("callers") >= many)


def seam_crossing(symbols: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = SEAM_DEPTH) -> DataFrame:
    """``fqn, reached``: backend symbols of changed contract, and how many frontend symbols they reach that didn't change with them."""
    place = symbols.select("fqn", is_frontend(F.col("file_path")).alias("front")).distinct()
    seeds = changed.where(F.col("kind").isin(*CONTRACTS)).select("fqn").distinct().join(place.where("NOT front"), "fqn", "left_semi")
    still = place.where("front").join(changed.select("fqn").distinct(), "fqn", "left_anti").select("fqn")
    seeds = settled(seeds)
    pairs, key = reached_by(edges, seeds, depth, still)
    counts = pairs.join(still.select(key(F.col("fqn")).alias("node")), "node", "left_semi").groupBy("seed").agg(F.count(F.lit(1)).alias("reached"))
    return counts.join(seeds.withColumn("seed", key(F.col("fqn"))), "seed").select("fqn", "reached")


def untested_changes(symbols: DataFrame, edges: DataFrame, changed: DataFrame, covered: DataFrame | None = None, depth: int = COVERAGE_DEPTH) -> DataFrame:
    """``fqn, dependents``: changed methods that something depends on and no test reaches, by a run (``covered``: fqn) or else by names."""
    test = symbols.select("fqn", is_test(F.col("file_path"), F.col("fqn")).alias("test")).distinct()
    mine = symbols.where("kind = 'method'").join(test.where("NOT test"), "fqn", "left_semi").select("fqn").distinct()
    seeds = changed.where("kind <> 'DELETED'").select("fqn").distinct().join(mine, "fqn", "left_semi")
    seeds = settled(seeds)
    pairs, key = reached_by(edges, seeds, depth, test)
    told = seeds.withColumn("seed", key(F.col("fqn")))
    if covered is not None:
        mine = told.join(covered.select("fqn").distinct(), "fqn", "left_anti")
        return pairs.groupBy("seed").agg(F.count(F.lit(1)).alias("dependents")).join(mine, "seed").select("fqn", "dependents")
    reach = pairs.join(test.select(key(F.col("fqn")).alias("node"), "test"), "node", "left")
    by = reach.groupBy("seed").agg(F.count(F.lit(1)).alias("dependents"), F.max(F.coalesce("test", F.lit(False))).alias("tested"))
    return by.where("NOT tested").join(told, "seed").select("fqn", "dependents")
