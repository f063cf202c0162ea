"""The index of a tree of files, and its update by what changed.

``scan`` builds an index from a tree and what its files were parsed into; ``rescan`` brings an index to a later tree and gives the same
rows as a new scan of that tree would, for edits, added, deleted and renamed files, at the cost of what changed:

1. candidates by size and time, then by hash; files that supplied edges for symbols of a deleted file are parsed again too;
2. symbols of parsed files are replaced by authority; what appeared and what vanished is held until all files are through, and only then paired into renames;
3. edges are replaced by the file they come from, and edges whose source is gone go;
4. resolved anew are the new edges and, of the others, those whose hint shares a key of some tier with a name that appeared or vanished; if
   the set of packages changed, also those without a target; if the declared supertypes of a parsed file changed, also those of members. A change
   of bodies alone resolves nothing else;
5. facts whose anchors no longer hold are invalidated, those whose anchors all hold are validated once a scan.

Tables: see ``Index``. ``tree``: path, size, mtime, content_hash. ``symbols`` and ``edges`` as parsed: fqn, name, sig_hash, body_hash, annotations,
authority, file_path, and src, edge_type, site_line, hint, file_path; of these only the rows of files to be parsed are used.

Edge cases: an empty tree deletes everything; a null hash is one that differs from every other; edges repeated in full are one edge, and
an edge whose source no live symbol is doesn't land; of a name that one file has twice, the last row by its columns counts; a fact without anchors
is neither invalidated nor validated; an index of no files is brought to any tree.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import graphql_coordinate, member_name, prefix_of, simple_key
from . import resolve
from .graph import live_names
from .incremental import change_of, file_renames, refused, renames, replace_symbols
from .settle import FEW_NUMBERS, released, settled, sized
from .states import intact_facts

BASE = ["src", "edge_type", "site_line", "hint", "file_path"]
SYMBOL = ["fqn", "name", "sig_hash", "body_hash", "annotations", "authority", "file_path", "deleted"]
SUPERS = ("extends", "implements")
DURABLE = 3


@dataclass(frozen=True)
class Index:
    """``files``: path, size, mtime, content_hash, deleted. ``symbols``: SYMBOL. ``edges``: BASE, dst, tier, resolution, confidence. ``anchors``:
    fact_key, path, fqn, sig_hash, body_hash. ``facts``: fact_key, validated, validated_scan, durable, invalidated (the scan that did it).
    ``aliases``: old_fqn, new_fqn, scan_id.

    An index that ``scan`` or ``rescan`` gives also has what its edges are joined from when they are read: ``parsed`` (BASE), ``hints`` (hint, head, n: how
    many edges) and ``targets`` (hint, head, dst, tier, resolution, confidence), as equal hints share their targets. Without them they are taken from its edges."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    anchors: DataFrame
    facts: DataFrame
    aliases: DataFrame
    parsed: DataFrame | None = None
    hints: DataFrame | None = None
    targets: DataFrame | None = None


@dataclass(frozen=True)
class Rescan:
    """``changes``: entity, path, fqn, from_fqn, change_type, detail. ``report``: what was counted."""

    index: Index
    changes: DataFrame
    report: dict[str, int | bool]


def same_revision(baseline: tuple, current: tuple) -> bool:
    """Whether nothing can have changed between two (commit, dirty, tool versions): the same clean commit under the same tools."""
    return baseline[0] is not None and not baseline[1] and not current[1] and baseline == current


def headed(edges: DataFrame) -> DataFrame:
    """``hint, head`` of edges, by which targets are shared."""
    return edges.select("hint", resolve.head_of(F.col("file_path"), F.col("hint")).alias("head"))


def counted(edges: DataFrame) -> DataFrame:
    """``hint, head, n``, also of null hints."""
    return headed(edges).groupBy("hint", "head").agg(F.count(F.lit(1)).alias("n"))


def joined(parsed: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges with targets, joined when they are read."""
    return resolve.linked(parsed.select(*BASE), targets, "file_path").select(*BASE, "dst", "tier", "resolution", "confidence")


def in_parts(index: Index) -> Index:
    """``index`` with its edges in parts, each a table."""
    if index.parsed is None:
        parsed = settled(index.edges.select(*BASE).distinct())
        targets = index.edges.select("dst", "tier", "resolution", "confidence", "hint", resolve.head_of(F.col("file_path"), F.col("hint")).alias("head")).where("hint IS NOT NULL").distinct()
        return replace(index, parsed=parsed, hints=settled(counted(parsed)), targets=settled(targets))
    written = lambda df: df if getattr(df, "_settled", None) else settled(df)
    return replace(index, parsed=written(index.parsed), hints=written(index.hints), targets=written(index.targets))


def declared_supers(edges: DataFrame) -> DataFrame:
    """``fqn, ancestor`` as edges name them."""
    return edges.where(F.col("edge_type").isin(*SUPERS) & F.col("hint").isNotNull()).select(F.col("src").alias("fqn"), F.col("hint").alias("ancestor")).distinct()


def landed(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Parsed edges, once each, whose source lives. Joined by source first, whose exchange and order serve the distinct rows too, which no table in memory then holds."""
    live = edges.select(*BASE).join(live_names(symbols).withColumnRenamed("fqn", "src"), "src", "left_semi").select(*BASE)
    return live.withColumn("__i", F.row_number().over(Window.partitionBy(*BASE).orderBy("src"))).where("__i = 1").select(*BASE)


def once(symbols: DataFrame) -> DataFrame:
    """Parsed symbols, one row for each name of a file."""
    rest = [c for c in SYMBOL if c not in ("fqn", "file_path", "deleted")]
    rows = symbols.groupBy("fqn", "file_path").agg(F.max(F.struct(*rest)).alias("x"))
    return rows.select("fqn", *[F.col(f"x.{c}").alias(c) for c in rest], "file_path", F.lit(False).alias("deleted")).select(*SYMBOL)


def scan(tree: DataFrame, symbols: DataFrame, edges: DataFrame, anchors: DataFrame, facts: DataFrame, aliases: DataFrame, linked: bool = True) -> Index:
    """The index of a tree, from nothing. One that isn't ``linked`` has its edges as parsed, without targets, which is enough for ``replaced``."""
    files = tree.select("path", "size", "mtime", "content_hash", F.lit(False).alias("deleted"))
    incoming = once(symbols.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi"))
    table = settled(replace_symbols(incoming.limit(0), incoming, files))
    parsed = edges.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    if not linked:
        return Index(files, table, parsed.select(*BASE), anchors, facts, aliases)
    own = settled(landed(parsed, table))
    hints = settled(counted(own))
    supers = settled(declared_supers(own))
    targets = resolve.resolve_hints(hints, table, supers, unique=True)
    released(supers)
    return Index(files, table, joined(own, targets), anchors, facts, aliases, own, hints, targets)


def candidates(files: DataFrame, tree: DataFrame, forced: bool = False, delta: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``path, content_hash, was`` of files to be parsed (``was``: they are known), and ``path, content_hash`` of those gone.

    ``delta`` (``path``) names all paths that may differ; without it the tree is the whole one. A file of known size and time isn't compared
    further, one of equal hash is only touched; ``forced`` parses all.
    """
    known = files.where("NOT deleted").select("path", F.col("size").alias("__s"), F.col("mtime").alias("__m"), F.col("content_hash").alias("__h"), F.lit(True).alias("__was"))
    if delta is not None:
        paths = delta.select("path").distinct()
        known, tree = known.join(paths, "path", "left_semi"), tree.join(paths, "path", "left_semi")
    both = tree.join(known, "path", "left")
    stat = F.coalesce((F.col("size") == F.col("__s")) & (F.col("mtime") == F.col("__m")), F.lit(False))
    moved = ~stat & ~F.coalesce(F.col("content_hash") == F.col("__h"), F.lit(False))
    changed = both.where(F.lit(forced) | F.col("__was").isNull() | moved).select("path", "size", "mtime", "content_hash", F.col("__was").isNotNull().alias("was"))
    return changed, known.join(tree.select("path"), "path", "left_anti").select("path", F.col("__h").alias("content_hash"))


def edge_suppliers(edges: DataFrame, symbols: DataFrame, gone: DataFrame) -> DataFrame:
    """``path`` of other files that edges of symbols of gone files (``path``) come from."""
    owned = settled(symbols.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("fqn").alias("src"), F.col("file_path").alias("owner")))
    # a name's hash tells which few edges may be theirs, so the others aren't exchanged for it
    hashes, n = sized(owned.select(F.xxhash64("src").alias("__h")).distinct(), FEW_NUMBERS)
    if n <= FEW_NUMBERS:
        edges = edges.join(hashes, F.xxhash64("src") == F.col("__h"), "left_semi")
    return edges.join(owned, "src").where("file_path <> owner").select(F.col("file_path").alias("path")).distinct()


def _keys(fqn: Column, of_hint: bool) -> Column:
    """What a hint and a symbol must share, one key for each tier, for the symbol to matter to the hint."""
    tagged = lambda t, c: F.concat(F.lit(t), c)
    if of_hint:
        member, prefix = prefix_of(F.regexp_replace(fqn, "^[^#]*#", "")), fqn
    else:
        member, prefix = member_name(fqn), F.when(fqn.contains("("), prefix_of(fqn))
    return F.array_compact(F.array(tagged("e", fqn), tagged("p", prefix), tagged("s", simple_key(fqn)), tagged("m", member), tagged("g", graphql_coordinate(fqn))))


def affected(edges: DataFrame, names: DataFrame, packages: bool, supers: bool) -> Column | DataFrame:
    """``hint`` of edges that may resolve otherwise now that names (``fqn``) appeared or vanished."""
    hints = edges.select("hint", F.col("dst").isNull().alias("bare")).where("hint IS NOT NULL")
    more = (F.lit(packages or supers) & F.col("bare")) | (F.lit(supers) & F.col("hint").contains("#"))
    # keys by their hashes: of two equal ones of different keys, one hint more is resolved again
    number = lambda of_hint, c: F.explode(F.transform(_keys(F.col(c), of_hint), lambda k: F.xxhash64(k))).alias("key")
    keys, _ = sized(names.select(number(False, "fqn")).distinct(), FEW_NUMBERS)
    out = hints.where(~more).select("hint", number(True, "hint")).join(keys, "key", "left_semi").select("hint")
    return out.unionByName(hints.where(more).select("hint")).distinct()


def settle_facts(facts: DataFrame, anchors: DataFrame, symbols: DataFrame, files: DataFrame, scan_id: int) -> DataFrame:
    """``facts`` after a scan: invalid if an anchor no longer holds, else validated; a fact counts a scan once and is durable from three on. An invalid one stays so."""
    held = intact_facts(anchors, symbols, files).withColumnRenamed("fact_key", "__f")
    both = facts.join(held, F.col("fact_key") == F.col("__f"), "left")
    live = F.col("invalidated").isNull()
    lost = live & (F.col("intact") == F.lit(False))
    kept = live & F.coalesce("intact", F.lit(False)) & ~F.coalesce(F.col("validated_scan") == scan_id, F.lit(False))
    n = F.when(kept, F.col("validated") + 1).otherwise(F.col("validated"))
    return both.select("fact_key", n.alias("validated"), F.when(kept, F.lit(scan_id).cast("long")).otherwise(F.col("validated_scan")).alias("validated_scan"), (F.coalesce("durable", F.lit(False)) | (kept & (n >= DURABLE))).alias("durable"), F.when(lost, F.lit(scan_id).cast("long")).otherwise(F.col("invalidated")).alias("invalidated"))


@dataclass(frozen=True)
class Replaced:
    """Files and symbols of the later tree, before edges: ``parsed`` and ``gone`` (path), both tables, what was parsed (``incoming``) and what was there (``before``), renames and the ledger."""

    parsed: DataFrame
    gone: DataFrame
    counts: dict[str, int]
    files: DataFrame | None = None
    symbols: DataFrame | None = None
    incoming: DataFrame | None = None
    before: DataFrame | None = None
    moved: DataFrame | None = None
    changes: DataFrame | None = None


def replaced(index: Index, tree: DataFrame, symbols: DataFrame, forced: bool = False, delta: DataFrame | None = None) -> Replaced:
    """Steps 1 and 2 of a rescan and their ledger, which no target of an edge enters: of the index's edges only source and file are read."""
    spark = tree.sparkSession
    changed, gone = (settled(x) for x in candidates(index.files, tree, forced, delta))
    more = edge_suppliers(index.edges if index.parsed is None else index.parsed, index.symbols, gone).join(tree.select("path"), "path", "left_semi").join(changed.select("path"), "path", "left_anti")
    parsed = settled(changed.select("path").unionByName(more))
    counts = {"files_changed": parsed.count(), "files_deleted": gone.count()}
    if not any(counts.values()):
        none = spark.createDataFrame([], "entity string, path string, fqn string, from_fqn string, change_type string, detail string")
        return Replaced(parsed, gone, counts, changes=none)
    at = parsed.select(F.col("path").alias("file_path"))
    lost = gone.select(F.col("path").alias("file_path"))
    out_of_date = at.unionByName(lost)

    # files and symbols
    stat = tree.join(parsed, "path", "left_semi").select("path", "size", "mtime", "content_hash", F.lit(False).alias("deleted"))
    dead = index.files.join(gone.select("path"), "path", "left_semi").withColumn("deleted", F.lit(True))
    files = settled(index.files.join(out_of_date.select(F.col("file_path").alias("path")), "path", "left_anti").unionByName(dead).unionByName(stat.select(*index.files.columns)))
    incoming = settled(once(symbols.join(at, "file_path", "left_semi")))
    before = settled(index.symbols.where("NOT deleted").join(out_of_date, "file_path", "left_semi").select(*SYMBOL))
    table = settled(replace_symbols(index.symbols.select(*SYMBOL), incoming, out_of_date.select(F.col("file_path").alias("path"))))
    written = settled(incoming.join(refused(table, incoming), ["fqn", "file_path"], "left_anti"))
    appeared = settled(written.join(before, ["fqn", "file_path"], "left_anti"))
    vanished = settled(before.join(incoming, ["fqn", "file_path"], "left_anti"))
    moved_files, moved = settled(file_renames(gone, changed.where("NOT was"))), settled(renames(vanished, appeared))

    # the ledger
    text = lambda c: F.lit(c).cast("string") if c is None or isinstance(c, str) else c.cast("string")

    def told(df: DataFrame, entity: str, kind: str | Column, detail: str | Column | None = None, path: str = "file_path", fqn: str | None = "fqn", from_fqn: str | None = None) -> DataFrame:
        col = lambda c: text(None) if c is None else F.col(c)
        return df.select(F.lit(entity).alias("entity"), col(path).alias("path"), col(fqn).alias("fqn"), col(from_fqn).alias("from_fqn"), text(kind).alias("change_type"), text(detail).alias("detail"))

    pack = lambda df, n: df.select("fqn", "file_path", F.struct("sig_hash", "body_hash", "annotations").alias(n))
    both = pack(before, "a").join(pack(written, "b"), ["fqn", "file_path"]).withColumn("change", change_of(F.col("a"), F.col("b"))).where("change IS NOT NULL")
    detail = F.when(F.col("change") == "api", "signature").when(F.col("change") == "body", "body").when(F.col("change") == "contract", "annotations").otherwise("both")
    known = index.files.where("NOT deleted").select("path", F.lit(True).alias("was"))
    ledger = [
        told(gone.join(moved_files, F.col("path") == F.col("old_path"), "left"), "file", F.when(F.col("old_path").isNotNull(), "renamed").otherwise("deleted"), path="path", fqn=None),
        told(parsed.join(known, "path", "left"), "file", F.when(F.col("was"), "modified").otherwise("added"), "content", path="path", fqn=None),
        told(both, "symbol", "modified", detail),
        told(moved.join(appeared.select(F.col("fqn").alias("new_fqn"), "file_path"), "new_fqn"), "symbol", "renamed", fqn="new_fqn", from_fqn="old_fqn"),
        told(vanished.join(moved, F.col("fqn") == F.col("old_fqn"), "left_anti"), "symbol", "deleted"),
        told(appeared.join(moved, F.col("fqn") == F.col("new_fqn"), "left_anti"), "symbol", "added"),
    ]
    changes = ledger[0]
    for rows in ledger[1:]:
        changes = changes.unionByName(rows)
    return Replaced(parsed, gone, counts, files, table, incoming, before, moved, settled(changes))


def packages_in(symbols: DataFrame) -> DataFrame:
    """``pkg`` of live symbols; names needn't be made distinct first."""
    return resolve.packages_of(symbols.where("NOT coalesce(deleted, false) AND fqn IS NOT NULL"))


def rescan(index: Index, tree: DataFrame, symbols: DataFrame, edges: DataFrame, scan_id: int, forced: bool = False, delta: DataFrame | None = None) -> Rescan:
    """The index brought to ``tree``; see the module. Nothing changed gives the index itself and no changes. The sources of the index's edges live."""
    given, index = index, in_parts(index)
    new = replaced(index, tree, symbols, forced, delta)
    counts, files, table, incoming, before, changes = new.counts, new.files, new.symbols, new.incoming, new.before, new.changes
    if not any(counts.values()):
        return Rescan(given, changes, {"unchanged": True, **counts, "symbols_changed": 0, "edges_walked": 0, "facts_invalidated": 0, "facts_validated": 0})
    at = new.parsed.select(F.col("path").alias("file_path"))
    out_of_date = at.unionByName(new.gone.select(F.col("path").alias("file_path")))
    aliases = index.aliases.unionByName(new.moved.select("old_fqn", "new_fqn", F.lit(scan_id).cast("long").alias("scan_id")))

    # edges: those of parsed and gone files are replaced, what may resolve otherwise is resolved anew
    fresh = settled(landed(edges.join(at, "file_path", "left_semi"), table))
    supers_of = lambda e: e.where(F.col("edge_type").isin(*SUPERS) & F.col("hint").isNotNull()).select("file_path", "src", "hint").distinct()
    was, now = supers_of(index.parsed.join(out_of_date, "file_path", "left_semi")), supers_of(fresh)
    supers_changed = not (was.join(now, ["file_path", "src", "hint"], "left_anti").isEmpty() and now.join(was, ["file_path", "src", "hint"], "left_anti").isEmpty())
    live_was, live_now = live_names(before.unionByName(index.symbols.join(incoming.select("fqn").distinct(), "fqn", "left_semi").select(*SYMBOL))), live_names(table)
    dead = settled(live_was.join(live_now, "fqn", "left_anti"))
    names = settled(dead.unionByName(live_names(table.join(incoming.select("fqn").distinct(), "fqn", "left_semi")).join(live_was, "fqn", "left_anti")))
    packages = settled(resolve.packages_of(names))
    side = lambda x, there: packages_in(x).join(packages, "pkg", "left_semi").select("pkg", F.lit(there).alias("there"))
    both_sides = side(index.symbols, 1).unionByName(side(table, 2)).groupBy("pkg").agg(F.sum("there").alias("there"))
    packages_changed = not both_sides.where("there <> 3").isEmpty()
    # a name's hash tells which few edges may have lost their source, so the others aren't exchanged for it
    rest = index.parsed.join(out_of_date, "file_path", "left_anti").select(*BASE)
    hashes, _ = sized(dead.select(F.xxhash64("fqn").alias("__h")).distinct(), FEW_NUMBERS)
    gone = dead.withColumnRenamed("fqn", "src")
    doubt = settled(rest.join(hashes, F.xxhash64("src") == F.col("__h"), "left_semi").select(*BASE))
    kept = rest.join(hashes, F.xxhash64("src") == F.col("__h"), "left_anti").unionByName(doubt.join(gone, "src", "left_anti").select(*BASE))
    lost = index.parsed.join(out_of_date, "file_path", "left_semi").select(*BASE).unionByName(doubt.join(gone, "src", "left_semi").select(*BASE))
    parsed = kept.unionByName(fresh)

    # hints of the edges there are now, which of them were there before, and which are to be resolved
    again = affected(index.targets, names, packages_changed, supers_changed).withColumn("__again", F.lit(True))
    tallied = index.hints.select("hint", "head", F.col("n").alias("was"), F.lit(0).alias("less"), F.lit(0).alias("more"))
    tallied = tallied.unionByName(headed(lost).select("hint", "head", F.lit(0).alias("was"), F.lit(1).alias("less"), F.lit(0).alias("more")))
    tallied = tallied.unionByName(headed(fresh).select("hint", "head", F.lit(0).alias("was"), F.lit(0).alias("less"), F.lit(1).alias("more")))
    sums = tallied.groupBy("hint", "head").agg(F.sum("was").alias("was"), F.sum("more").alias("more"), (F.sum("was") - F.sum("less") + F.sum("more")).alias("n")).where("n > 0")
    again_too = F.coalesce("__again", F.lit(False))
    state = settled(sums.join(again, "hint", "left").select("hint", "head", "n", F.when(again_too, F.col("n")).otherwise(F.col("more")).alias("walked"), (again_too | (F.col("was") == 0)).alias("asked")))
    all_supers = settled(declared_supers(parsed))
    found = resolve.resolve_hints(state.where("asked"), table, all_supers, unique=True)
    targets = settled(index.targets.join(state.where("NOT asked").select("hint", "head"), ["hint", "head"], "left_semi").select(*found.columns).unionByName(found))
    walked = state.agg(F.coalesce(F.sum("walked"), F.lit(0)).alias("n")).first().n

    facts = settled(settle_facts(index.facts, index.anchors, table, files, scan_id))
    done = facts.agg(F.count_if(F.col("invalidated") == scan_id).alias("i"), F.count_if((F.col("validated_scan") == scan_id) & F.col("invalidated").isNull()).alias("v")).first()
    counts |= {"symbols_changed": changes.where("entity = 'symbol'").count(), "edges_walked": walked, "facts_invalidated": done.i, "facts_validated": done.v}
    released(all_supers, found, packages)
    after = replace(index, files=files, symbols=table, edges=joined(parsed, targets), facts=facts, aliases=aliases, parsed=parsed, hints=state.select("hint", "head", "n"), targets=targets)
    return Rescan(after, changes, {"unchanged": False, **counts})
