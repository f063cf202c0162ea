"""Edges judged against an oracle by position: references and definitions in, judgements out.

A site is a file and line. The oracle may have several references there, so a site has several right definitions; an edge contains one if its
target's span, in the same file, holds the definition's line. Of a site's edges those with the narrowest containing span are right. Spans and
definitions meet per site and file in the order of their lines, so neither many edges nor many definitions of one site are multiplied.

Edge cases: an edge without a line has no site and isn't counted; one without a target, or with half a span, contains nothing; edges of types or tiers
the oracle can't judge are blind, those of sites where it says nothing are silent, and both are counted and left out; a symbol defined twice is at
its first place by file and line; repeated edges are judged each; empty tables give no judgements and counts of zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What an oracle can judge, tiers that no symbol table resolved, and the least share of files it must have seen.
COMPARABLE = ("calls", "implements", "extends", "imports")
NOT_RESOLVED = ("external", "sibling", "external-graph", "unresolved", "framework")
MIN_FILE_COVERAGE = 0.95
SITE, SPAN = ["src_file", "site_line"], ["dst_file", "dst_start", "dst_end"]


def truths(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``src_file, site_line, dst_file, def_line``: where what is referred to (``file, line, symbol``) is defined (``symbol, file, line``)."""
    one = defs.groupBy("symbol").agg(F.min(F.struct("file", "line")).alias("d"))
    return refs.join(one, "symbol").select(F.col("file").alias("src_file"), F.col("line").alias("site_line"), F.col("d.file").alias("dst_file"), F.col("d.line").alias("def_line")).distinct()


def judgeable() -> Column:
    return F.coalesce(F.col("edge_type").isin(*COMPARABLE) & ~F.col("tier").isin(*NOT_RESOLVED), F.lit(False))


def met(rows: DataFrame) -> DataFrame:
    """``verdict`` for each row that is an edge, with what else the row has.

    A row (``src_file, site_line, dst_file, dst_start, dst_end, known_line, edge, can, known``) is an edge if ``edge``, which the oracle can judge if ``can``, and
    tells if ``known`` that the oracle refers at its site to ``known_line`` of ``dst_file``. Files are names, or numbers that stand for one each. Rows that
    come dealt by site aren't exchanged again. From below, a file's lines are gone through in order, so each span sees the first definition from its
    start on and none is paired with another.
    """
    edge, can, told = F.col("edge"), F.col("edge") & F.col("can"), F.coalesce(F.col("known") & F.col("src_file").isNotNull(), F.lit(False))
    # 0: the edge, at its start; 1: what is known, at its line
    of = F.explode(F.when(edge & told, F.array(F.lit(0), F.lit(1))).when(edge, F.array(F.lit(0))).when(told, F.array(F.lit(1))))
    points = rows.where("site_line IS NOT NULL").withColumn("__of", of).withColumn("__at", F.when(F.col("__of") == 0, F.col("dst_start")).otherwise(F.col("known_line")))
    defined = F.col("__of") == 1
    before = Window.partitionBy(*SITE, "dst_file").orderBy(F.desc_nulls_last("__at"), F.desc("__of")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = points.withColumn("__next", F.min(F.when(defined, F.col("__at"))).over(before))
    holds = ~defined & can & F.col("dst_file").isNotNull() & F.col("dst_start").isNotNull() & (F.col("__next") <= F.col("dst_end"))
    site = Window.partitionBy(*SITE)
    wide = seen.withColumn("__width", F.when(holds, F.col("dst_end") - F.col("dst_start")))
    out = wide.withColumn("__best", F.min("__width").over(site)).withColumn("__told", F.max("__of").over(site)).where(~defined)
    right = F.coalesce(F.col("__width") == F.col("__best"), F.lit(False))
    verdict = F.when(~can, "blind").when(F.col("__told") == 0, "silent").when(right, "right").otherwise("wrong")
    return out.withColumn("verdict", verdict).drop("known_line", "edge", "can", "known", "__of", "__at", "__next", "__width", "__best", "__told")


def compared(edges: DataFrame, refs: DataFrame, defs: DataFrame) -> DataFrame:
    """``edges`` (``src_file, site_line, edge_type, tier, dst_file, dst_start, dst_end``) with ``verdict``: right, wrong, silent or blind."""
    known = truths(refs, defs).withColumnRenamed("def_line", "known_line").withColumns({"edge": F.lit(False), "can": F.lit(False), "known": F.lit(True)})
    rows = edges.withColumns({"edge": F.lit(True), "can": judgeable(), "known": F.lit(False)}).unionByName(known, allowMissingColumns=True)
    return met(rows.repartition(*SITE)).select(*edges.columns, "verdict")


def comparison(judged: DataFrame) -> DataFrame:
    """One row ``sites, judged, correct, silent, blind`` of what ``compared`` gives."""
    v = F.col("verdict")
    return judged.agg(F.count_distinct(*SITE).alias("sites"), F.count_if(v.isin("right", "wrong")).alias("judged"), F.count_if(v == "right").alias("correct"), F.count_if(v == "silent").alias("silent"), F.count_if(v == "blind").alias("blind"))


def file_coverage(files: DataFrame, documents: DataFrame) -> DataFrame:
    """One row ``comparable, seen, coverage, partial``: of the files (``path``) with an extension that some oracle document (``path``) has, those it has seen."""
    extension = lambda c: F.when(c.rlike(r"\.[^./]+$"), F.regexp_extract(c, r"\.([^./]+)$", 1)).otherwise("")
    docs = documents.select("path").distinct()
    kinds = docs.select(extension(F.col("path")).alias("e")).distinct()
    mine = files.select("path").distinct().withColumn("e", extension(F.col("path"))).join(kinds, "e", "left_semi").join(docs.withColumn("there", F.lit(True)), "path", "left")
    share = F.when(F.col("comparable") > 0, F.col("seen") / F.col("comparable")).otherwise(0.0)
    return mine.agg(F.count(F.lit(1)).alias("comparable"), F.count("there").alias("seen")).withColumn("coverage", share).withColumn("partial", F.col("coverage") < MIN_FILE_COVERAGE)
