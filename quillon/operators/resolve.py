"""Resolution of textual hints into edges: a ladder of tiers, each a join, of which the first that applies counts.

| tier | applies if | confidence | resolution |
|-|-|-|-|
| exact, contract | the hint is a symbol's name; contract if it is a GraphQL name | 1.0, .95 | exact, contract |
| prefix | the hint is the name of 1 to 4 symbols before their parameters | .9 / n | heuristic |
| graphql | the coordinate is served by some routes: by one, or one in the caller's top-level folder, else by each of n | .95, 1 / n | contract, heuristic |
| inherited | the nearest supertype, to depth 8, has the member, once | .85 | heuristic |
| simple | ``Type#member`` without package is unique | .7 | heuristic |
| member | the bare member (``m`` or ``#m``) is that of 1 to 4 symbols | .6 / n | heuristic |
| sibling, external | its package, or that of the nearest supertype outside, isn't the project's; sibling if the project's owner's | 0 | sibling, external |
| unresolved | otherwise | 0 | unresolved |

Hints are made distinct first. The tiers that go by one key of a symbol are answered together: keys of symbols and of hints meet after one
exchange, are counted there, and only those with few enough symbols are joined; so no hint has more than four rows a tier, but for routes of
one coordinate. Routes and supertypes are looked through only for hints that neither a name nor a prefix answers. Of supertypes at one depth
the first by name counts. Deleted symbols are no candidates.

Edge cases: a null hint is unresolved; equal hints share their result; symbols count once by name; without ``supers`` or ``src_path``
the tiers that need them never apply; no symbols: every hint with a package is external.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import graphql_coordinate, graphql_module, member_name, package_of, prefix_of, simple_key, type_part
from .graph import ancestors, live_names
from .settle import released, settled

DEPTH = 8
#: Places of the tiers in the ladder.
EXACT, PREFIX, GRAPHQL, INHERITED, SIMPLE, MEMBER, NONE = range(7)


def package_root(packages: DataFrame) -> DataFrame:
    """``root``: the owner, two segments, of more than half of the packages (``pkg``) that have one; else no row."""
    owned = packages.where(F.col("pkg").contains(".")).select("pkg").distinct()
    by = owned.groupBy(F.regexp_extract("pkg", r"^[^.]*\.[^.]*", 0).alias("root")).agg(F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(owned.agg(F.count(F.lit(1)).alias("all")))).where(F.col("n") * 2 > F.col("all")).select("root")


def packages_of(symbols: DataFrame) -> DataFrame:
    """``pkg``: the packages that symbols are in."""
    return symbols.select(package_of(F.col("fqn")).alias("pkg")).where("pkg <> ''").distinct()


def candidates(asked: DataFrame, names: DataFrame) -> DataFrame:
    """``hint, head, tier, dst, n`` of the best of the tiers that go by one key of a symbol, by their places in the ladder; one row of tier ``NONE`` where none applies.

    All keys of all symbols meet all hints after one exchange; counted there, those of too many symbols go before they are joined.
    """
    f, h = F.col("fqn"), F.col("hint")
    one = lambda tag, key, tier: F.when(key.isNotNull(), F.struct(F.concat(F.lit(tag), key).alias("key"), F.lit(tier).alias("tier")))
    of_symbol = F.array_compact(F.array(one("h", f, EXACT), one("h", F.when(f.contains("("), prefix_of(f)), PREFIX), one("s", simple_key(f), SIMPLE), one("m", member_name(f), MEMBER)))
    keyed = names.select(f.alias("dst"), F.explode(of_symbol).alias("x")).select("x.key", "x.tier", "dst").repartition("key")
    # a full name is one symbol's; the other keys of a kind have one tier each
    keyed = keyed.withColumn("n", F.count_if(F.col("tier") != EXACT).over(Window.partitionBy("key")))
    keyed = keyed.where((F.col("tier") == EXACT) | (F.col("n") <= F.when(F.col("tier") == SIMPLE, 1).otherwise(4)))
    bare = F.regexp_replace(h, "^#", "")
    bare = F.when(~bare.contains("#") & ~bare.contains("(") & ~bare.contains("::"), bare)
    tagged = lambda tag, key: F.concat(F.lit(tag), key)
    looked = asked.select("hint", "head", F.explode(F.array_compact(F.array(tagged("h", h), tagged("s", simple_key(h)), tagged("m", bare)))).alias("key"))
    none = asked.select("hint", "head", F.lit(NONE).alias("tier"), F.lit(None).cast("string").alias("dst"), F.lit(0).cast("long").alias("n"))
    met = looked.join(keyed, "key").select("hint", "head", "tier", "dst", "n").unionByName(none)
    return met.withColumn("best", F.min("tier").over(Window.partitionBy("hint", "head"))).where("tier = best").drop("best")


def resolve_hints(asked: DataFrame, symbols: DataFrame, supers: DataFrame | None = None, unique: bool = False) -> DataFrame:
    """``hint, head, dst, tier, resolution, confidence`` of hints (``hint, head``), one row per candidate, or one without a target.

    ``head`` is the caller's top-level folder, for GraphQL hints; ``unique`` hints are there once each. Only what has neither an exact nor a prefix match is asked of routes and supertypes.
    ``symbols``: fqn and maybe deleted; ``supers``: fqn, ancestor as declared, which are written once unless they are a table of ``settled``.
    """
    f, h = F.col("fqn"), F.col("hint")
    s = settled(live_names(symbols))
    asked = asked.where("hint IS NOT NULL").select("hint", "head")
    state = settled(candidates(asked if unique else asked.distinct(), s))
    left = state.where(F.col("tier") > GRAPHQL).select("hint", "head")
    spent, found = [s, state], state.limit(0)

    coordinates = left.withColumn("key", graphql_coordinate(h)).where("key IS NOT NULL").distinct()
    if not coordinates.isEmpty():
        routes = coordinates.join(s.select(graphql_coordinate(f).alias("key"), f.alias("dst")).where("key IS NOT NULL"), "key")
        near = (F.split_part(F.coalesce(graphql_module(F.col("dst")), F.lit("")), F.lit("/"), F.lit(1)) == F.col("head")) & (F.col("head") != "")
        routes = settled(routes.select("hint", "head", "dst", near.alias("near")))
        alone = routes.groupBy("hint", "head").agg(F.sum(F.col("near").cast("int")).alias("near_n"), F.count(F.lit(1)).alias("all_n"))
        routes_n = routes.join(alone, ["hint", "head"]).where("near_n <> 1 OR near").withColumn("n", F.when(F.col("near_n") == 1, 1).otherwise(F.col("all_n")))
        found = found.unionByName(routes_n.select("hint", "head", F.lit(GRAPHQL).alias("tier"), "dst", "n"))
        spent.append(routes)

    above = None
    if supers is not None:
        # the closure begins at the types that hints are left for, and goes no further than they ask
        types = left.where(~h.startswith("graphql:")).select(type_part(h).alias("fqn"))
        declared = supers if getattr(supers, "_settled", None) else settled(supers.select("fqn", "ancestor").distinct())
        above = settled(ancestors(types, declared, DEPTH).where("fqn <> ancestor"))
        member = left.where(h.contains("#") & ~h.startswith("graphql:")).withColumn("fqn", type_part(h)).join(above, "fqn").distinct()
        member = settled(member.withColumn("key", F.concat("ancestor", F.lit("#"), F.regexp_replace(h, "^[^#]*#", ""))))
        spent += [above, member] + ([] if declared is supers else [declared])
        if not member.isEmpty():
            full = member.join(s.select(f.alias("key"), f.alias("dst")), "key")
            # one symbol is its own least one, so nothing is joined again
            prefixes = s.select(F.when(f.contains("("), prefix_of(f)).alias("key"), f.alias("dst")).join(member.select("key"), "key", "left_semi")
            once = member.join(prefixes.groupBy("key").agg(F.min("dst").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n"), "key")
            hits = full.unionByName(once.select(*full.columns)).groupBy("hint", "head").agg(F.min(F.struct("depth", "ancestor", F.col("dst"))).alias("x"))
            found = found.unionByName(hits.select("hint", "head", F.lit(INHERITED).alias("tier"), F.col("x.dst").alias("dst"), F.lit(1).cast("long").alias("n")))
    found = settled(found)
    spent.append(found)
    rows = state if found.isEmpty() else state.join(found.select("hint", "head"), ["hint", "head"], "left_anti").unionByName(found)

    # what no tier resolves: outside of the project, or not found; of a package of its own, else of that of the nearest supertype outside
    packages = settled(packages_of(s))
    spent.append(packages)
    inside = packages.select(F.col("pkg").alias("own"), F.lit(True).alias("inside"))
    none = rows.where(F.col("tier") == NONE).withColumn("own", package_of(h)).join(inside, "own", "left")
    pkg = F.when((F.col("own") != "") & F.col("inside").isNull(), F.col("own"))
    if above is not None:
        up = above.withColumn("pkg", F.when(F.col("ancestor").contains("."), F.regexp_extract("ancestor", r"^(.*)\.", 1)).otherwise("")).where("pkg <> ''").join(packages, "pkg", "left_anti")
        first = up.groupBy("fqn").agg(F.min(F.struct("depth", "ancestor", "pkg")).alias("x")).select(F.col("fqn").alias("type"), F.col("x.pkg").alias("above"))
        none, pkg = none.withColumn("type", type_part(h)).join(first, "type", "left"), F.coalesce(pkg, "above")
    none = none.select("hint", "head", pkg.alias("pkg")).crossJoin(F.broadcast(package_root(packages).agg(F.coalesce(F.first("root"), F.lit("")).alias("root"))))
    sibling = (F.col("root") != "") & ((F.col("pkg") == F.col("root")) | F.col("pkg").startswith(F.concat("root", F.lit("."))))
    place = F.when(F.col("pkg").isNull(), "unresolved").when(sibling, "sibling").otherwise("external")
    none = none.select("hint", "head", F.lit(None).cast("string").alias("dst"), place.alias("tier"), place.alias("resolution"), F.lit(0.0).alias("confidence"))

    graphql, t, n = h.startswith("graphql:"), F.col("tier"), F.col("n")
    name = F.when(t == EXACT, F.when(graphql, "contract").otherwise("exact")).when(t == PREFIX, "prefix").when(t == GRAPHQL, "graphql").when(t == INHERITED, "inherited").when(t == SIMPLE, "simple").otherwise("member")
    how = F.when(t == EXACT, name).when((t == GRAPHQL) & (n == 1), "contract").otherwise("heuristic")
    sure = F.when(t == EXACT, F.when(graphql, 0.95).otherwise(1.0)).when(t == PREFIX, F.lit(0.9) / n).when(t == GRAPHQL, F.when(n == 1, 0.95).otherwise(F.lit(1.0) / n))
    sure = sure.when(t == INHERITED, 0.85).when(t == SIMPLE, 0.7).otherwise(F.lit(0.6) / n)
    told = rows.where(t != NONE).select("hint", "head", "dst", name.alias("tier"), how.alias("resolution"), sure.cast("double").alias("confidence"))
    out = settled(none.unionByName(told))
    released(*spent)
    return out


def head_of(path: Column, hint: Column) -> Column:
    """The caller's top-level folder, which matters to GraphQL hints only."""
    return F.when(hint.startswith("graphql:"), F.split_part(F.coalesce(path, F.lit("")), F.lit("/"), F.lit(1))).otherwise("")


def linked(hints: DataFrame, targets: DataFrame, path: str = "src_path") -> DataFrame:
    """``hints`` (see ``resolve``) with the targets of theirs, as ``resolve_hints`` gives them."""
    headed = hints if "head" in hints.columns else hints.withColumn("head", head_of(F.col(path) if path in hints.columns else F.lit(""), F.col("hint")))
    place = F.lit("unresolved")
    out = headed.join(targets, ["hint", "head"], "left")
    return out.select(*[c for c in hints.columns if c not in ("src_path", "head")], "dst", F.coalesce("tier", place).alias("tier"), F.coalesce("resolution", place).alias("resolution"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def resolve(hints: DataFrame, symbols: DataFrame, supers: DataFrame | None = None, path: str = "src_path") -> DataFrame:
    """``src, edge_type, site_line, hint, dst, tier, resolution, confidence``: one row per edge and candidate of its tier.

    ``hints``: ``src, edge_type, site_line, hint`` and maybe ``src_path``, written once unless they are a table of ``settled``, as they are read for the
    ladder and joined to its answers; columns besides these stay, and so does the path's if it is ``path`` by another name. ``symbols`` and ``supers`` as in ``resolve_hints``.
    """
    headed = hints.withColumn("head", head_of(F.col(path) if path in hints.columns else F.lit(""), F.col("hint")))
    asked = headed if getattr(hints, "_settled", None) else settled(headed)
    return linked(asked, resolve_hints(asked, symbols, supers), path)
