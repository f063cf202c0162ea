"""Registered queries of findings: their lifecycle over scans, history, and what is known about pieces of code."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings
from . import derive
from .catalog import NO_CTE, query
from .derive import read

EVENTS = """WITH RECURSIVE b AS (SELECT min(ts)::DATE AS first FROM events), al AS (SELECT DISTINCT 'u' || user_id || 'x' AS old, 'u' || user_id AS new FROM events WHERE user_id % 5 = 0),
e AS (SELECT 'review' AS capability, 'u' || user_id || CASE WHEN user_id % 5 = 0 AND (ts::DATE - first) < 10 THEN 'x' ELSE '' END AS f0, (ts::DATE - first)::BIGINT + 1 AS dy, event_type, user_id % 7 AS component, user_id FROM events, b),
e1 AS (SELECT DISTINCT capability, coalesce(al.new, f0) AS fingerprint, dy, event_type, component, user_id FROM e LEFT JOIN al ON al.old = f0),
si AS (SELECT DISTINCT fingerprint, dy, 2 AS o, 'sighted' AS kind, CASE WHEN user_id % 2 = 0 THEN 'UNVERIFIED' ELSE 'SUSPECTED' END AS status FROM e1 WHERE event_type = 'error'),
days AS (SELECT DISTINCT dy, component FROM e1 WHERE dy % 7 = component OR dy % 3 = 0), kn AS (SELECT DISTINCT fingerprint, component FROM e1 WHERE event_type = 'error'),
ex AS (SELECT kn.fingerprint, dy, 1 AS o, 'examined' AS kind, NULL AS status FROM kn JOIN days USING (component) WHERE NOT EXISTS (SELECT 1 FROM si WHERE si.fingerprint = kn.fingerprint AND si.dy = days.dy)),
rp AS (SELECT DISTINCT fingerprint, dy, 3 AS o, 'reproduced' AS kind, NULL AS status FROM e1 WHERE event_type = 'purchase' AND user_id % 3 = 0), di AS (SELECT DISTINCT fingerprint, dy, 4 AS o, 'dismissed' AS kind, NULL AS status FROM e1 WHERE event_type = 'signup' AND user_id % 4 = 0),
ev AS (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY dy, o) AS i FROM (SELECT * FROM si UNION ALL SELECT * FROM ex UNION ALL SELECT * FROM rp UNION ALL SELECT * FROM di)),
f(fingerprint, i, status, previous, first_seen, last_seen, fixed_at, regressions) AS (SELECT DISTINCT fingerprint, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT FROM ev
 UNION ALL SELECT fingerprint, i, s, CASE WHEN s IS DISTINCT FROM status THEN status ELSE previous END, coalesce(first_seen, CASE WHEN kind = 'sighted' THEN dy END), CASE WHEN kind = 'sighted' THEN dy ELSE last_seen END, CASE WHEN s IS DISTINCT FROM status AND s = 'FIXED' THEN dy ELSE fixed_at END, regressions + coalesce((s IS DISTINCT FROM status AND s = 'REGRESSED')::INT, 0) FROM
 (SELECT ev.fingerprint, ev.i, ev.kind, ev.dy, f.status, f.previous, f.first_seen, f.last_seen, f.fixed_at, f.regressions, CASE WHEN ev.kind = 'sighted' THEN CASE WHEN f.status IS NULL THEN ev.status WHEN f.status = 'FIXED' THEN 'REGRESSED' ELSE f.status END WHEN f.status IS NULL THEN NULL WHEN ev.kind = 'dismissed' THEN 'IGNORED' WHEN ev.kind = 'reproduced' THEN CASE WHEN f.status IN ('SUSPECTED', 'UNVERIFIED') THEN 'VERIFIED' WHEN f.status = 'FIXED' THEN 'REGRESSED' ELSE f.status END WHEN f.status IN ('SUSPECTED', 'UNVERIFIED', 'VERIFIED', 'REGRESSED') THEN 'FIXED' ELSE f.status END AS s FROM f JOIN ev ON ev.fingerprint = f.fingerprint AND ev.i = f.i + 1))
SELECT 'review' AS capability, fingerprint, status, previous, first_seen, last_seen, fixed_at, regressions FROM f WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY i DESC) = 1"""


@query("finding_states_kept", NO_CTE + EVENTS)
def finding_states_kept(spark, d):
    """Users as findings, errors as sightings, days as scans of some components; fingerprints of some users changed after ten days. Two batches, the second going on from the first."""
    e = read(spark, d, "events")
    first = F.broadcast(e.agg(F.min(F.to_date("ts")).alias("first")))
    u = F.col("user_id")
    e = e.crossJoin(first).withColumn("at", (F.datediff(F.to_date("ts"), "first") + 1).cast("long"))
    name = F.concat(F.lit("u"), u.cast("string"))
    e = e.select(F.lit("review").alias("capability"), F.when((u % 5 == 0) & (F.col("at") <= 10), F.concat(name, F.lit("x"))).otherwise(name).alias("fingerprint"), "at", "event_type", (u % 7).alias("component"), "user_id")
    aliases = read(spark, d, "events").where("user_id % 5 = 0").select(F.concat(name, F.lit("x")).alias("old_fqn"), name.alias("new_fqn")).distinct()
    e = findings.settled(findings.canonical(e, aliases).distinct())
    none = F.lit(None).cast("string").alias("status")
    of = lambda where, kind, status=none: e.where(where).select("capability", "fingerprint", "at", F.lit(kind).alias("kind"), status)
    seen = of("event_type = 'error'", "sighted", F.when(u % 2 == 0, "UNVERIFIED").otherwise("SUSPECTED").alias("status"))
    scans = e.where("at % 7 = component OR at % 3 = 0").select("at", "capability", "component")
    gone = findings.examined(seen, scans, e.where("event_type = 'error'"))
    events = findings.settled(seen.unionByName(gone).unionByName(of("event_type = 'purchase' AND user_id % 3 = 0", "reproduced")).unionByName(of("event_type = 'signup' AND user_id % 4 = 0", "dismissed")))
    half = findings.settled(findings.fold(events.where("at <= 12")))
    return findings.fold(events.where("at > 12"), half)


FOUND = """, fi AS (SELECT 'F-' || p_partkey AS uid, 'catalog.' || p_brand || '#part_' || p_partkey || '(' || p_size || ')' AS anchor_fqn, p_brand AS component, CASE p_size % 6 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' WHEN 4 THEN 'info' END AS severity FROM part),
oc AS (SELECT uid, 'catalog/' || component || '/' || (p_partkey % 9) || '.java' AS file_path FROM fi JOIN part ON uid = 'F-' || p_partkey WHERE p_partkey % 8 > 0)"""


def found(spark, d):
    p = read(spark, d, "part")
    k, z = F.col("p_partkey"), F.col("p_size")
    uid = F.concat(F.lit("F-"), k.cast("string")).alias("uid")
    severity = F.when(z % 6 == 0, "critical").when(z % 6 == 1, "high").when(z % 6 == 2, "medium").when(z % 6 == 3, "low").when(z % 6 == 4, "info")
    name = F.concat(F.lit("catalog."), "p_brand", F.lit("#part_"), k.cast("string"), F.lit("("), z.cast("string"), F.lit(")"))
    path = F.concat(F.lit("catalog/"), "p_brand", F.lit("/"), (k % 9).cast("string"), F.lit(".java"))
    return p.select(uid, name.alias("anchor_fqn"), F.col("p_brand").alias("component"), severity.alias("severity")), p.where(k % 8 > 0).select(uid, path.alias("file_path"))


@query("findings_for", FOUND + """, t AS (SELECT DISTINCT unnest(['part_' || p_partkey, p_brand, 'catalog/' || p_brand || '/' || (p_size % 9) || '.java', 'catalog.' || p_brand || '#part_' || p_partkey || '(' || p_size || ')', '_' || (p_partkey % 50)]) AS target FROM part WHERE p_partkey % 40 = 0),
m AS (SELECT DISTINCT target, fi.uid, severity FROM t, fi JOIN oc USING (uid) WHERE oc.file_path = target OR component = target OR anchor_fqn = target OR (NOT contains(target, '/') AND NOT ends_with(target, '.java') AND (ends_with(lower(anchor_fqn), lower(target)) OR contains(lower(anchor_fqn), lower(target) || '('))))
SELECT target, uid, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END AS rank FROM m""")
def findings_for(spark, d):
    """Parts as findings; asked for by parts of names, components, paths, whole names and endings."""
    p = read(spark, d, "part").where("p_partkey % 40 = 0")
    k, z = F.col("p_partkey").cast("string"), F.col("p_size")
    part = F.concat(F.lit("part_"), k)
    asked = F.array(part, F.col("p_brand"), F.concat(F.lit("catalog/"), "p_brand", F.lit("/"), (z % 9).cast("string"), F.lit(".java")), F.concat(F.lit("catalog."), "p_brand", F.lit("#"), part, F.lit("("), z.cast("string"), F.lit(")")), F.concat(F.lit("_"), (F.col("p_partkey") % 50).cast("string")))
    known, seen = found(spark, d)
    return findings.findings_for(known, seen, derive.symbols(spark, d), p.select(F.explode(asked).alias("target")))


def _suggest_sql() -> str:
    live = "(SELECT fqn FROM symbols WHERE NOT deleted)"
    sql = FOUND + f""", sd AS (SELECT DISTINCT fqn FROM symbols WHERE kind = 'method' AND start_line % 10 = 1 AND starts_with(fqn, 'catalog.') OR kind = 'class' ORDER BY fqn LIMIT 40),
st AS (SELECT dst AS node, src AS nxt, edge_type, confidence, weight FROM edges JOIN weights ON wt = edge_type WHERE src IN {live}), cap AS (SELECT * FROM st QUALIFY row_number() OVER (PARTITION BY node ORDER BY confidence DESC, nxt, edge_type) <= 200),
l0 AS (SELECT fqn AS seed, fqn AS node, 1.0::DOUBLE AS val FROM sd WHERE fqn IN {live}), """
    for k in range(1, 6):
        before = " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(1, k)) or "SELECT * FROM l0 WHERE false"
        sql += f"""m{k} AS (SELECT seed, nxt AS node, max(val * weight * confidence) AS val FROM l{k - 1} l JOIN cap ON cap.node = l.node WHERE val * weight * confidence >= 0.15 AND nxt <> seed GROUP BY 1, 2),
l{k} AS (SELECT m.seed, m.node, m.val FROM m{k} m LEFT JOIN (SELECT seed, node, max(val) AS had FROM ({before}) GROUP BY 1, 2) b ON b.seed = m.seed AND b.node = m.node WHERE had IS NULL OR m.val > had), """
    every = " UNION ".join(f"SELECT seed, node FROM l{k}" for k in range(1, 6))
    return sql + f"""re AS (SELECT seed, node FROM ({every}) x JOIN (SELECT fqn, min(file_path) AS p FROM symbols GROUP BY 1) s ON s.fqn = node WHERE NOT (contains(p, '/test/') OR contains(p, '/tests/') OR regexp_matches(p, '\\.(test\\.ts|test\\.tsx|spec\\.ts)$') OR contains(node, 'Test#') OR regexp_matches(node, 'Tests?$'))),
rn AS (SELECT seed AS target, least(count(*), 100) AS reach FROM re GROUP BY 1), pr AS (SELECT sd.fqn AS target, count(DISTINCT fi.uid) AS prior FROM sd, fi JOIN oc USING (uid) WHERE oc.file_path = sd.fqn OR component = sd.fqn OR ends_with(lower(anchor_fqn), lower(sd.fqn)) OR contains(lower(anchor_fqn), lower(sd.fqn) || '(') GROUP BY 1),
sc AS (SELECT fqn AS target, coalesce(reach, 0) AS reach, coalesce(prior, 0) AS prior FROM sd LEFT JOIN rn ON rn.target = fqn LEFT JOIN pr ON pr.target = fqn)
SELECT row_number() OVER (ORDER BY reach + 3 * prior DESC, target)::INT AS rank, target, reach, prior, reach + 3 * prior AS score FROM sc WHERE reach + 3 * prior > 0 ORDER BY score DESC, target LIMIT 10"""


@query("suggestions", _suggest_sql())
def suggestions(spark, d):
    """Ten of forty changed symbols, by what depends on them and the findings about them."""
    e, s = derive.graph_tables(spark, d)
    changed = s.where("(kind = 'method' AND start_line % 10 = 1 AND fqn LIKE 'catalog.%') OR kind = 'class'").select("fqn")
    return findings.suggest(e, s, changed, *found(spark, d))
