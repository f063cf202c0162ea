"""What the index says about symbols, edges and files, of what lives.

``symbols``: fqn, kind, parent_fqn, file_path, start_line, deleted; ``edges``: src, dst, edge_type, confidence, site_line and more; ``files``: path, lang, deleted.

Edge cases: an edge whose source is deleted isn't there, one whose target is deleted has none; a deleted parent still names its children's owner;
a name that is no live symbol is looked up under the name it has now; null paths match nothing; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .incremental import alias_of


def live(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("deleted", F.lit(False)))


def file_facts(files: DataFrame) -> DataFrame:
    """``path, lang`` of the live files."""
    return live(files).select("path", "lang")


def symbol_facts(symbols: DataFrame) -> DataFrame:
    """``fqn, kind, file_path, start_line, parent_fqn, parent_kind`` of the live symbols."""
    parents = symbols.groupBy("fqn").agg(F.min("kind").alias("parent_kind")).withColumnRenamed("fqn", "__p")
    out = live(symbols).join(parents, F.col("parent_fqn") == F.col("__p"), "left")
    return out.select("fqn", "kind", "file_path", "start_line", F.col("__p").alias("parent_fqn"), "parent_kind")


def symbol_facts_in(symbols: DataFrame, edges: DataFrame, paths: DataFrame) -> DataFrame:
    """``symbol_facts`` of the live symbols in files (``path``), and of those one edge away from them in either direction."""
    there = paths.select(F.col("path").alias("file_path")).distinct()
    own = live(symbols).join(there, "file_path", "left_semi").select("fqn").distinct()
    out = edges.join(own.withColumnRenamed("fqn", "src"), "src", "left_semi").select(F.col("dst").alias("fqn"))
    into = edges.join(own.withColumnRenamed("fqn", "dst"), "dst", "left_semi").select(F.col("src").alias("fqn"))
    return symbol_facts(symbols).join(own.unionByName(out).unionByName(into).distinct(), "fqn", "left_semi")


def edge_facts(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of live sources, ``dst`` null where the target isn't live."""
    names = live(symbols).select("fqn").distinct()
    kept = edges.join(names.withColumnRenamed("fqn", "src"), "src", "left_semi")
    return kept.join(names.withColumnRenamed("fqn", "__d"), F.col("dst") == F.col("__d"), "left").withColumn("dst", F.col("__d")).select(*edges.columns)


def _far(symbols: DataFrame) -> DataFrame:
    return live(symbols).select(F.col("fqn").alias("other"), "kind", "file_path", "start_line")


def edges_into(symbols: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """``fqn, other, kind, file_path, start_line, edge_type, confidence, site_line``: the live symbols with an edge to each name (``fqn``)."""
    mine = edges.join(names.select(F.col("fqn").alias("dst")).distinct(), "dst", "left_semi").withColumnRenamed("src", "other")
    return mine.join(_far(symbols), "other").select(F.col("dst").alias("fqn"), "other", "kind", "file_path", "start_line", "edge_type", "confidence", "site_line")


def edges_out(symbols: DataFrame, edges: DataFrame, names: DataFrame) -> DataFrame:
    """As ``edges_into``, of the live symbols that each name has an edge to."""
    mine = edges.join(names.select(F.col("fqn").alias("src")).distinct(), "src", "left_semi").withColumnRenamed("dst", "other")
    return mine.join(_far(symbols), "other").select(F.col("src").alias("fqn"), "other", "kind", "file_path", "start_line", "edge_type", "confidence", "site_line")


def symbol_detail(symbols: DataFrame, edges: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``asked, fqn, way, other, edge_type, confidence``: the neighbours, in and out, of each name (``fqn``) or of the name it goes by now (``old_fqn, new_fqn``)."""
    here = live(symbols).select("fqn").distinct()
    asked = names.select("fqn").distinct()
    gone = asked.join(here, "fqn", "left_anti")
    moved = alias_of(aliases, gone).select(F.col("fqn").alias("asked"), F.col("now").alias("fqn")).join(here, "fqn", "left_semi").select("asked", "fqn")
    meant = asked.join(here, "fqn", "left_semi").select(F.col("fqn").alias("asked"), "fqn").unionByName(moved)
    way = lambda df, w: df.select("fqn", F.lit(w).alias("way"), "other", "edge_type", "confidence")
    both = way(edges_into(symbols, edges, meant), "in").unionByName(way(edges_out(symbols, edges, meant), "out"))
    return meant.join(both, "fqn").select("asked", "fqn", "way", "other", "edge_type", "confidence")


def old_names(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """``fqn, old_fqn``: every name (``old_fqn, new_fqn``) that each name (``fqn``) had before, directly or further back."""
    every = alias_of(aliases, aliases.select(F.col("old_fqn").alias("fqn")).distinct()).select(F.col("fqn").alias("old_fqn"), F.col("now").alias("fqn"))
    return every.where("fqn <> old_fqn").join(names.select("fqn").distinct(), "fqn", "left_semi").select("fqn", "old_fqn")


def edge_counts(edges: DataFrame) -> DataFrame:
    """One row ``sites, resolved, external, sibling, external_graph``: call sites (``src, site_line, hint``), and those with a target or a place of each kind (``dst, resolution``)."""
    r = F.col("resolution")
    flags = {"resolved": F.col("dst").isNotNull() & (r != "external-graph"), "external": r == "external", "sibling": r == "sibling", "external_graph": r == "external-graph"}
    each = edges.groupBy("src", "site_line", "hint").agg(*[F.max(F.coalesce(v, F.lit(False)).cast("int")).alias(k) for k, v in flags.items()])
    return each.agg(F.count(F.lit(1)).alias("sites"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in flags])
