"""Findings as kept state: what each scan, dismissal and verification makes of them, their history, and the findings about a piece of code.

A finding is known by its capability and fingerprint; where a symbol was renamed, its older fingerprints name the same finding. Its events go by
time; the state is folded over them, so a later batch of events goes on from the state of an earlier one and gives the same as both at once:

| event | state before | state after |
|-|-|-|
| sighted | none | its first status: unverified with evidence, else suspected |
| sighted | FIXED | REGRESSED |
| sighted | other | as it was; IGNORED is sticky |
| examined, not sighted | open | FIXED |
| dismissed | any | IGNORED |
| reproduced | SUSPECTED, UNVERIFIED | VERIFIED |
| reproduced | FIXED | REGRESSED |

Edge cases: events of one time go by kind in the order examined, sighted, reproduced, dismissed, and a repeated event changes nothing more; a finding
that was never sighted has no state, whatever else happens; code that wasn't examined says nothing; alias chains are followed to
their end; a null status counts as suspected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .context import find_many
from .incremental import alias_of
from .settle import settled
from .states import OPEN

# Kinds of events in the order that one time has them, and severities, the worst first.
KINDS = ("examined", "sighted", "reproduced", "dismissed")
SEVERITIES = ("critical", "high", "medium", "low")
STATE = "capability string, fingerprint string, status string, previous string, first_seen long, last_seen long, fixed_at long, regressions long"


def canonical(events: DataFrame, aliases: DataFrame) -> DataFrame:
    """Events with the fingerprint that their finding has today, by aliases of fingerprints (``old_fqn, new_fqn``)."""
    now = alias_of(aliases, events.select(F.col("fingerprint").alias("fqn")).distinct())
    return events.join(now, F.col("fingerprint") == F.col("fqn"), "left").withColumn("fingerprint", F.coalesce("now", "fingerprint")).drop("fqn", "now")


def _folded(status: Column, event: Column) -> Column:
    """The status after an event, of the status before; null before the first sighting."""
    kind = event["kind"]
    sighted = F.when(status.isNull(), F.coalesce(event["status"], F.lit("SUSPECTED"))).when(status == "FIXED", "REGRESSED").otherwise(status)
    verified = F.when(status.isin("SUSPECTED", "UNVERIFIED"), "VERIFIED").when(status == "FIXED", "REGRESSED").otherwise(status)
    return F.when(kind == "sighted", sighted).when(status.isNull(), status).when(kind == "dismissed", "IGNORED").when(kind == "reproduced", verified).when((kind == "examined") & status.isin(*OPEN), "FIXED").otherwise(status)


def examined(sightings: DataFrame, scans: DataFrame, state: DataFrame) -> DataFrame:
    """Events that a finding wasn't there although its code was looked at.

    ``sightings``: capability, fingerprint, at; ``scans``: at, capability, component, what each scan looked at; ``state``: capability, fingerprint,
    component of known findings. Only findings of components that a scan looked at meet it.
    """
    looked = scans.select("at", "capability", "component").distinct()
    could = state.select("capability", "fingerprint", "component").distinct().join(looked, ["capability", "component"]).select("capability", "fingerprint", "at")
    seen = sightings.select("capability", "fingerprint", "at").distinct()
    return could.join(seen, ["capability", "fingerprint", "at"], "left_anti").select("capability", "fingerprint", "at", F.lit("examined").alias("kind"), F.lit(None).cast("string").alias("status"))


def fold(events: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """The state (STATE) of each finding after events (``capability, fingerprint, at, kind, status``), going on from an earlier state.

    A finding's events meet in one group, which its scans bound; they are counted once each before. Findings without events stay as they are.
    """
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    one = events.where(F.col("kind").isin(*KINDS)).groupBy("capability", "fingerprint", "at", "kind").agg(F.min("status").alias("status"))
    lists = one.groupBy("capability", "fingerprint").agg(F.array_sort(F.collect_list(F.struct("at", order.alias("o"), "kind", "status"))).alias("events"))
    before = (state if state is not None else events.sparkSession.createDataFrame([], STATE)).select(F.col("capability").alias("__c"), F.col("fingerprint").alias("__f"), F.struct("status", "previous", "first_seen", "last_seen", "fixed_at", "regressions").alias("s"))
    both = lists.join(before, (F.col("capability") == F.col("__c")) & (F.col("fingerprint") == F.col("__f")), "full_outer")
    start = F.coalesce("s", F.struct(F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("previous"), *[F.lit(None).cast("long").alias(c) for c in ("first_seen", "last_seen", "fixed_at")], F.lit(0).cast("long").alias("regressions")))

    def step(acc: Column, e: Column) -> Column:
        after = _folded(acc["status"], e)
        moved = ~after.eqNullSafe(acc["status"])
        sighted = e["kind"] == "sighted"
        return F.struct(
            after.alias("status"), F.when(moved, acc["status"]).otherwise(acc["previous"]).alias("previous"), F.coalesce(acc["first_seen"], F.when(sighted, e["at"])).alias("first_seen"),
            F.when(sighted, e["at"]).otherwise(acc["last_seen"]).alias("last_seen"), F.when(moved & (after == "FIXED"), e["at"]).otherwise(acc["fixed_at"]).alias("fixed_at"), (acc["regressions"] + (moved & (after == "REGRESSED")).cast("long")).alias("regressions"),
        )

    done = F.aggregate(F.coalesce("events", F.array().cast("array<struct<at: bigint, o: bigint, kind: string, status: string>>")), start, step)
    out = both.select(F.coalesce("capability", "__c").alias("capability"), F.coalesce("fingerprint", "__f").alias("fingerprint"), done.alias("x"))
    return out.where("x.status IS NOT NULL").select("capability", "fingerprint", "x.*")


def verification_outcome(verdict: Column, named: Column) -> Column:
    """What a verification says of a finding whose file its failing output names or not."""
    return F.when((verdict == "failed") & named, "reproduced").when((verdict == "inconclusive") & named, "reproduced_preexisting").when(verdict == "verified", "not_reproduced").otherwise("inconclusive")


def history(occurrences: DataFrame, scans: DataFrame) -> DataFrame:
    """``uid, at, scan_uid, commit, status, confidence`` of every sighting (``uid, at, status, confidence``), of scans that are known (``at, scan_uid, commit``)."""
    one = occurrences.groupBy("uid", "at").agg(F.max(F.struct("status", "confidence")).alias("x"))
    return one.join(scans.select("at", "scan_uid", "commit"), "at").select("uid", "at", "scan_uid", "commit", "x.status", "x.confidence")


def latest_evidence(occurrences: DataFrame) -> DataFrame:
    """``uid, at, evidence`` of each finding's last sighting."""
    return occurrences.groupBy("uid").agg(F.max_by(F.struct("at", "evidence"), F.struct("at", "evidence")).alias("x")).select("uid", "x.at", "x.evidence")


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(0).cast("long")) - 1, F.lit(len(SEVERITIES))).cast("int")


def findings_for(findings: DataFrame, occurrences: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """``target, uid, severity, rank`` of findings about each target (``target``): sighted in the file of that path, anchored at a symbol of that name
    or of a name that ends with it, before parameters or behind them, or of that component.

    ``findings``: uid, anchor_fqn, component, severity; ``occurrences``: uid, file_path. Each of the ways is an equi join; ``find_many`` says how ends are
    matched. Deleted anchors are found too, as the finding is still about them; a finding never sighted isn't about anything.
    """
    t = targets.select("target").where("target IS NOT NULL").distinct()
    seen = occurrences.select("uid", "file_path").distinct()
    known = findings.join(seen.select("uid").distinct(), "uid", "left_semi")
    by_path = t.join(seen, F.col("target") == F.col("file_path")).select("target", "uid")
    by_component = t.join(known, F.col("target") == F.col("component")).select("target", "uid")
    anchors = known.where("anchor_fqn IS NOT NULL").select("uid", F.col("anchor_fqn").alias("fqn"))
    names = anchors.select("fqn").distinct().join(symbols.select("fqn").distinct(), "fqn", "left_semi")
    # every name that ends with a target, with no path or route reading of it, and no name of its own besides
    ends = find_many(names.select("fqn", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("file_path"), F.lit(0).alias("start_line")), t).select("target", "fqn")
    same = t.join(names, F.col("target") == F.col("fqn")).select("target", "fqn")
    by_anchor = ends.unionByName(same).distinct().join(anchors, "fqn").select("target", "uid")
    pairs = by_path.unionByName(by_component).unionByName(by_anchor).distinct()
    return pairs.join(findings.select("uid", "severity"), "uid").select("target", "uid", "severity", severity_rank(F.col("severity")).alias("rank"))


def covered(coverage: DataFrame, symbols: DataFrame) -> DataFrame:
    """``fqn`` of live symbols that a run proved to be covered (``fqn, source``)."""
    live = symbols.where(~F.coalesce("deleted", F.lit(False))).select("fqn").distinct()
    return coverage.where("source = 'runtime'").select("fqn").distinct().join(live, "fqn", "left_semi")


def reach(edges: DataFrame, seeds: DataFrame, symbols: DataFrame, depth: int = 5, floor: float = 0.15, cap: int = 200) -> DataFrame:
    """``seed, fqn, score`` of what each seed (``fqn``) reaches against the edges, all seeds in one traversal.

    As ``graph.traverse`` for each seed alone: caps are a node's and so the same for all; an arrival is followed if it is above what its seed had at the node.
    The front is a row for each seed and node, so seeds should be a stated few; those that no symbol is reach nothing.
    """
    from .graph import capped, live_names, weighted

    there = live_names(symbols)
    steps = weighted(edges, True)
    front = settled(seeds.select("fqn").distinct().join(there, "fqn", "left_semi").select(F.col("fqn").alias("seed"), F.col("fqn").alias("node"), F.lit(1.0).alias("at")))
    best = front.limit(0)
    for _ in range(depth):
        nodes = front.select("node").distinct()
        picked = settled(capped(steps.join(nodes, "node", "left_semi").join(there.withColumnRenamed("fqn", "next"), "next", "left_semi"), cap))
        moved = front.join(picked, "node").select("seed", F.col("next").alias("node"), (F.col("at") * F.col("weight") * F.col("confidence")).alias("at")).where((F.col("at") >= floor) & (F.col("seed") != F.col("node")))
        new = moved.groupBy("seed", "node").agg(F.max("at").alias("at")).join(best.select("seed", "node", F.col("at").alias("had")), ["seed", "node"], "left").where("had IS NULL OR at > had").drop("had")
        front = settled(new)
        if front.isEmpty():
            break
        best = settled(best.unionByName(front).groupBy("seed", "node").agg(F.max("at").alias("at")))
    return best.select("seed", F.col("node").alias("fqn"), F.col("at").alias("score"))


def suggest(edges: DataFrame, symbols: DataFrame, changed: DataFrame, findings: DataFrame, occurrences: DataFrame, changes: int = 40, top: int = 10, items: int = 100) -> DataFrame:
    """``rank, target, reach, prior, score``: which of the first ``changes`` changed names (``fqn``, by name) to look at first.

    The score is how many symbols but tests depend on a name, up to ``items``, and three for every finding about it; without either it isn't suggested.
    """
    from ..functions.names import is_test

    seeds = settled(changed.select("fqn").where("fqn IS NOT NULL").distinct().orderBy("fqn").limit(changes))
    places = symbols.groupBy("fqn").agg(F.min("file_path").alias("file_path"))
    far = reach(edges, seeds, symbols).join(places, "fqn").where(~is_test(F.col("file_path"), F.col("fqn")))
    n = far.groupBy(F.col("seed").alias("target")).agg(F.least(F.count(F.lit(1)), F.lit(items)).alias("reach"))
    prior = findings_for(findings, occurrences, symbols, seeds.withColumnRenamed("fqn", "target")).groupBy("target").agg(F.count(F.lit(1)).alias("prior"))
    both = seeds.withColumnRenamed("fqn", "target").join(n, "target", "left").join(prior, "target", "left").fillna(0, ["reach", "prior"])
    scored = both.withColumn("score", F.col("reach") + 3 * F.col("prior")).where("score > 0")
    first = scored.orderBy(F.desc("score"), "target").limit(top)  # a report of ten rows
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "target"))).select("rank", "target", "reach", "prior", "score")
