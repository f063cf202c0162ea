"""States of findings, changes and verifications, and scores of judged edges.

Edge cases: a null status is not open; null evidence is none; no checks, or a blocked one, leave an outcome unknown; no judged edges score 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import subject_prefixes
from .evaluation import wilson

# Open states; change kinds with their type and detail in the ledger.
OPEN = ("SUSPECTED", "UNVERIFIED", "VERIFIED", "REGRESSED")
LEDGER = {
    "API_CHANGED": ("modified", "signature"),
    "BODY_CHANGED": ("modified", "body"),
    "CONTRACT_CHANGED": ("modified", "annotations"),
    "API_AND_BODY_CHANGED": ("modified", "both"),
    "ADDED": ("added", None),
    "DELETED": ("deleted", None),
    "RENAMED": ("renamed", None),
}


def is_open(status: Column) -> Column:
    return F.coalesce(status.isin(*OPEN), F.lit(False))


def initial_status(evidence: Column) -> Column:
    return F.when(F.coalesce(F.size(evidence), F.lit(0)) > 0, "UNVERIFIED").otherwise("SUSPECTED")


def to_ledger(kind: Column) -> tuple[Column, Column]:
    """Type and detail of a change kind."""
    out = []
    for i in (0, 1):
        c = F.lit(None).cast("string")
        for k, v in LEDGER.items():
            c = F.when(kind == k, F.lit(v[i]).cast("string")).otherwise(c)
        out.append(c)
    return out[0], out[1]


def from_ledger(change_type: Column, detail: Column) -> Column:
    """The change kind; a modification of unknown or no detail is one of the body, another type none."""
    of = {"signature": "API_CHANGED", "annotations": "CONTRACT_CHANGED", "both": "API_AND_BODY_CHANGED"}
    modified = F.lit("BODY_CHANGED")
    for k, v in of.items():
        modified = F.when(detail == k, v).otherwise(modified)
    return F.when(change_type == "added", "ADDED").when(change_type == "deleted", "DELETED").when(change_type == "renamed", "RENAMED").when(change_type == "modified", modified)


def outcome(checks: DataFrame, *by: str) -> DataFrame:
    """``by, outcome`` of checks (``failed, blocked``): unknown if any is blocked, else failed if any failed, else passed."""
    hit = F.when(F.max(F.coalesce("blocked", F.lit(False))), "unknown").when(F.max(F.coalesce("failed", F.lit(False))), "failed").otherwise("passed")
    return checks.groupBy(*by).agg(hit.alias("outcome"))


def verdict(baseline: Column, head: Column) -> Column:
    """Of outcomes at two revisions; a null baseline wasn't run, a null head has no checks."""
    head = F.coalesce(head, F.lit("unknown"))
    alone = F.when(head == "passed", "verified").when(head == "failed", "failed").otherwise("inconclusive")
    both = F.when((head == "passed") & baseline.isin("passed", "failed"), "verified").when((head == "failed") & (baseline == "passed"), "failed").otherwise("inconclusive")
    return F.when(baseline.isNull(), alone).otherwise(both)


def scores(judged: DataFrame, *site: str) -> DataFrame:
    """``measure, value, low, high`` of precision by edge, recall and strict recall by site, and F1; needs ``site, correct``."""
    y = F.coalesce(F.col("correct").cast("long"), F.lit(0))
    per = judged.groupBy(*site).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("right"))
    one = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), F.coalesce(F.sum("right"), F.lit(0)).alias("correct"), F.count(F.lit(1)).alias("sites"), F.count_if(F.col("right") > 0).alias("hit"), F.count_if((F.col("n") == 1) & (F.col("right") == 1)).alias("strict"))
    share = lambda k, n: F.when(F.col(n) > 0, F.col(k) / F.col(n)).otherwise(0.0)
    p, r = share("correct", "edges"), share("hit", "sites")
    rows = []
    for name, k, n in (("precision", "correct", "edges"), ("recall", "hit", "sites"), ("strict", "strict", "sites")):
        low, high = wilson(F.col(k), F.col(n))
        rows.append(F.struct(F.lit(name).alias("measure"), share(k, n).alias("value"), F.when(F.col(n) > 0, low).alias("low"), F.when(F.col(n) > 0, high).alias("high")))
    none = F.lit(None).cast("double")
    rows.append(F.struct(F.lit("f1").alias("measure"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("value"), none.alias("low"), none.alias("high")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def merged_seeds(offers: DataFrame) -> DataFrame:
    """``fqn, source, strength``: of offers (``source``: less is better, ``strength``: more) the best of each, independently, in order of source and name."""
    return offers.groupBy("fqn").agg(F.min("source").alias("source"), F.max("strength").alias("strength")).orderBy("source", "fqn")


def intact_facts(anchors: DataFrame, symbols: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``fact_key, intact``: whether every anchor (``fact_key, path, fqn, sig_hash, body_hash``) still holds.

    One with a name holds if that symbol lives in that file with both hashes as they were; one without a name holds as long as its file lives. Deleted
    symbols and files (``path`` and maybe ``deleted``) hold nothing; without ``files``, a file lives that has a live symbol. A null hash equals none.
    """
    living = lambda df: df.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in df.columns else df
    path = "file_path" if "file_path" in symbols.columns else "path"
    own = living(symbols).withColumnRenamed(path, "path")
    cols = ["path", "fqn", "sig_hash", "body_hash"]
    there = living(files if files is not None else own).select("path").distinct()
    held = own.select(*cols).distinct().join(there, "path", "left_semi").withColumn("__there", F.lit(True))
    named = anchors.where("fqn IS NOT NULL").join(held, cols, "left").select("fact_key", F.coalesce("__there", F.lit(False)).alias("ok"))
    bare = anchors.where("fqn IS NULL").join(there.withColumn("__there", F.lit(True)), "path", "left").select("fact_key", F.coalesce("__there", F.lit(False)).alias("ok"))
    return named.unionByName(bare).groupBy("fact_key").agg(F.min("ok").alias("intact"))


def facts_for_seeds(facts: DataFrame, seeds: DataFrame) -> DataFrame:
    """``seed, fact_key`` of facts (``fact_key, subject``) about a seed (``fqn``), one of its ancestors, or any name that starts with it.

    Both arms are equi joins: the second on the beginnings of subjects of the lengths that seeds have, of which there are no more
    than a name has signs.
    """
    s = seeds.select(F.col("fqn").alias("seed")).distinct()
    above = s.select("seed", F.explode(subject_prefixes(F.col("seed"))).alias("subject")).join(facts, "subject").select("seed", "fact_key")
    lengths = F.broadcast(s.agg(F.collect_set(F.length("seed")).alias("lengths")))
    starts = F.filter("lengths", lambda n: n <= F.length("subject"))
    begun = facts.crossJoin(lengths).select("fact_key", F.explode(F.transform(starts, lambda n: F.substring(F.col("subject"), F.lit(1), n))).alias("seed"))
    return above.unionByName(begun.join(s, "seed").select("seed", "fact_key")).distinct()
