"""Registered queries of the review rules, states and name forms, over views made up from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import graph, incremental, rules, states
from . import derive
from .catalog import FORWARD, NO_CTE, SEEDS, impact_sql, micro, query, seeds
from .derive import read

ANNOTATED = """, ann AS (SELECT *, CASE WHEN kind = 'class' THEN CASE WHEN start_line % 2 = 0 THEN ['@Service'] ELSE ['Entity'] END WHEN start_line % 5 = 0 THEN ['@Transactional(readOnly = true)'] WHEN start_line % 7 = 0 THEN ['TransactionalEventListener'] END AS annotations, CASE start_line % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'private' END AS visibility FROM symbols),
tx AS (SELECT fqn, parent_fqn, kind, visibility, len(list_filter(coalesce(annotations, []), lambda a: ltrim(a, '@') = 'Transactional' OR starts_with(ltrim(a, '@'), 'Transactional('))) > 0 AS tx FROM ann),
bean AS (SELECT DISTINCT fqn AS owner FROM ann WHERE len(list_filter(coalesce(annotations, []), lambda a: regexp_matches(ltrim(a, '@'), '^(Service|Component|Repository|Controller|RestController)($|\\()'))) > 0)
"""
CHANGED = """, changed AS (SELECT fqn, CASE start_line % 8 WHEN 0 THEN 'API_CHANGED' WHEN 1 THEN 'CONTRACT_CHANGED' WHEN 2 THEN 'BODY_CHANGED' WHEN 3 THEN 'API_AND_BODY_CHANGED' ELSE 'DELETED' END AS kind FROM symbols WHERE start_line % 8 < 5),
front AS (SELECT fqn, kind, regexp_matches(file_path, '\\.(ts|tsx|jsx|js)$') AS front, contains(file_path, '/test/') OR contains(file_path, '/tests/') OR regexp_matches(file_path, '\\.(test\\.ts|test\\.tsx|spec\\.ts)$') OR contains(fqn, 'Test#') OR regexp_matches(fqn, 'Tests?$') AS test FROM symbols),
step AS (SELECT DISTINCT dst AS node, src AS nxt FROM edges WHERE src <> dst)
"""


def annotated(s):
    of_class = F.when(F.col("start_line") % 2 == 0, F.array(F.lit("@Service"))).otherwise(F.array(F.lit("Entity")))
    ann = F.when(F.col("kind") == "class", of_class).when(F.col("start_line") % 5 == 0, F.array(F.lit("@Transactional(readOnly = true)"))).when(F.col("start_line") % 7 == 0, F.array(F.lit("TransactionalEventListener")))
    seen = F.when(F.col("start_line") % 3 == 0, "public").when(F.col("start_line") % 3 == 1, "private")
    return s.withColumn("annotations", ann).withColumn("visibility", seen)


def changed(s):
    k = F.col("start_line") % 8
    kind = F.when(k == 0, "API_CHANGED").when(k == 1, "CONTRACT_CHANGED").when(k == 2, "BODY_CHANGED").when(k == 3, "API_AND_BODY_CHANGED").otherwise("DELETED")
    return s.where(k < 5).select("fqn", kind.alias("kind"))


@query("transactional_non_public", ANNOTATED + "SELECT fqn, coalesce(visibility, 'package-private') AS visibility FROM tx JOIN bean ON owner = parent_fqn WHERE kind = 'method' AND tx AND coalesce(visibility, 'package-private') <> 'public'")
def transactional_non_public(spark, d):
    return rules.transactional_non_public(annotated(derive.symbols(spark, d)))


@query("self_invocation", ANNOTATED + ", within AS (SELECT DISTINCT a.fqn AS src, b.fqn AS dst FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN mem a ON a.t = 'supplier' AND a.k = l_suppkey JOIN mem b ON b.t = 'customer' AND b.k = o_custkey) SELECT src, dst FROM within JOIN tx a ON a.fqn = src JOIN tx b ON b.fqn = dst JOIN bean ON owner = a.parent_fqn WHERE a.parent_fqn = b.parent_fqn AND b.tx AND NOT a.tx")
def self_invocation(spark, d):
    """Calls from the suppliers of an order's lines to its customer; some are of one nation."""
    m = derive.members(spark, d)
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    calls = lines.join(m["supplier"].select(F.col("k").alias("l_suppkey"), F.col("fqn").alias("src")), "l_suppkey").join(m["customer"].select(F.col("k").alias("o_custkey"), F.col("fqn").alias("dst")), "o_custkey")
    return rules.self_invocation(annotated(derive.symbols(spark, d)), calls.select("src", "dst", F.lit("calls").alias("edge_type")))


@query("orphan_operations", NO_CTE + """WITH s AS (SELECT DISTINCT 'graphql:Query.f' || p_size AS fqn FROM part), h AS (SELECT DISTINCT 'c' || o_custkey AS src, CASE WHEN o_orderkey % 9 = 0 THEN 'graphql:op:x' ELSE 'graphql:Query.f' || (o_orderkey % 80) END AS hint FROM orders)
SELECT DISTINCT src, substr(hint, 9) AS field FROM h WHERE hint NOT IN (SELECT fqn FROM s) AND NOT starts_with(hint, 'graphql:op:') AND src IN (SELECT 'c' || c_custkey FROM customer)""")
def orphan_operations(spark, d):
    """Fields that orders of a customer ask for and no part's size serves."""
    routes = read(spark, d, "part").select(F.concat(F.lit("graphql:Query.f"), F.col("p_size").cast("string")).alias("fqn"), F.lit("route").alias("kind")).distinct()
    callers = read(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("fqn"), F.lit("method").alias("kind"))
    hint = F.when(F.col("o_orderkey") % 9 == 0, "graphql:op:x").otherwise(F.concat(F.lit("graphql:Query.f"), (F.col("o_orderkey") % 80).cast("string")))
    asked = read(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), hint.alias("hint"))
    return rules.orphan_operations(routes.unionByName(callers), asked.join(routes, asked["hint"] == routes["fqn"], "left_anti"))


@query("stale_callers", CHANGED + "SELECT dst AS fqn, count(DISTINCT src) AS callers FROM edges WHERE dst IN (SELECT fqn FROM changed WHERE kind IN ('API_CHANGED', 'API_AND_BODY_CHANGED')) AND src NOT IN (SELECT fqn FROM changed) GROUP BY dst HAVING count(DISTINCT src) >= 3")
def stale_callers(spark, d):
    s = derive.symbols(spark, d)
    return rules.stale_callers(s, derive.edges(spark, d), changed(s))


@query("seam_crossing", CHANGED + """, seed AS (SELECT DISTINCT fqn FROM changed JOIN front USING (fqn) WHERE changed.kind IN ('API_CHANGED', 'API_AND_BODY_CHANGED', 'CONTRACT_CHANGED') AND NOT front),
r(seed, node, depth) AS (SELECT fqn, fqn, 0 FROM seed UNION SELECT seed, nxt, depth + 1 FROM r JOIN step USING (node) WHERE depth < 5)
SELECT seed AS fqn, count(DISTINCT node) AS reached FROM r WHERE node <> seed AND node IN (SELECT fqn FROM front WHERE front) AND node NOT IN (SELECT fqn FROM changed) GROUP BY seed""")
def seam_crossing(spark, d):
    s = derive.symbols(spark, d)
    return rules.seam_crossing(s, derive.edges(spark, d), changed(s))


UNTESTED = CHANGED + """, seed AS (SELECT DISTINCT fqn FROM changed JOIN front USING (fqn) WHERE changed.kind <> 'DELETED' AND front.kind = 'method' AND NOT test),
r(seed, node, depth) AS (SELECT fqn, fqn, 0 FROM seed UNION SELECT seed, nxt, depth + 1 FROM r JOIN step USING (node) WHERE depth < 4), p AS (SELECT DISTINCT seed, node FROM r WHERE node <> seed)
"""


@query("untested_changes", UNTESTED + "SELECT seed AS fqn, count(*) AS dependents FROM p LEFT JOIN front ON fqn = node GROUP BY seed HAVING NOT max(coalesce(test, false))")
def untested_changes(spark, d):
    s = derive.symbols(spark, d)
    return rules.untested_changes(s, derive.edges(spark, d), changed(s))


@query("uncovered_changes", UNTESTED + "SELECT seed AS fqn, count(*) AS dependents FROM p WHERE seed NOT IN (SELECT fqn FROM symbols WHERE start_line % 16 = 2) GROUP BY seed")
def uncovered_changes(spark, d):
    """As ``untested_changes``, with what a test run has reached."""
    s = derive.symbols(spark, d)
    return rules.untested_changes(s, derive.edges(spark, d), changed(s), s.where("start_line % 16 = 2").select("fqn"))


@query("change_ledger", NO_CTE + """WITH k AS (SELECT o_orderkey, ['API_CHANGED', 'BODY_CHANGED', 'CONTRACT_CHANGED', 'API_AND_BODY_CHANGED', 'ADDED', 'DELETED', 'RENAMED'][(o_orderkey % 7 + 1)::INT] AS kind FROM orders)
SELECT o_orderkey, kind, CASE kind WHEN 'ADDED' THEN 'added' WHEN 'DELETED' THEN 'deleted' WHEN 'RENAMED' THEN 'renamed' ELSE 'modified' END AS change_type, CASE kind WHEN 'API_CHANGED' THEN 'signature' WHEN 'BODY_CHANGED' THEN 'body' WHEN 'CONTRACT_CHANGED' THEN 'annotations' WHEN 'API_AND_BODY_CHANGED' THEN 'both' END AS detail, kind AS again FROM k""")
def change_ledger(spark, d):
    """Kinds to the ledger's type and detail, and back."""
    kind = F.element_at(F.array(*map(F.lit, states.LEDGER)), (F.col("o_orderkey") % 7 + 1).cast("int"))
    type_, detail = states.to_ledger(F.col("kind"))
    rows = read(spark, d, "orders").select("o_orderkey", kind.alias("kind")).withColumns({"change_type": type_, "detail": detail})
    return rows.withColumn("again", states.from_ledger(F.col("change_type"), F.col("detail")))


@query("finding_states", NO_CTE + """WITH f AS (SELECT ['SUSPECTED', 'UNVERIFIED', 'VERIFIED', 'FIXED', 'REGRESSED', 'IGNORED', NULL][(o_orderkey % 7 + 1)::INT] AS status, o_orderkey % 3 AS evidence FROM orders)
SELECT status, coalesce(status IN ('SUSPECTED', 'UNVERIFIED', 'VERIFIED', 'REGRESSED'), false) AS open, CASE WHEN evidence > 0 THEN 'UNVERIFIED' ELSE 'SUSPECTED' END AS first, count(*) AS n FROM f GROUP BY ALL""")
def finding_states(spark, d):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("SUSPECTED", "UNVERIFIED", "VERIFIED", "FIXED", "REGRESSED", "IGNORED")), F.lit(None).cast("string")), (k % 7 + 1).cast("int"))
    evidence = F.when(k % 3 == 1, F.array(F.lit("a"))).when(k % 3 == 2, F.array(F.lit("a"), F.lit("b")))
    f = read(spark, d, "orders").select(status.alias("status"), evidence.alias("evidence"))
    return f.groupBy("status", states.is_open(F.col("status")).alias("open"), states.initial_status(F.col("evidence")).alias("first")).agg(F.count(F.lit(1)).alias("n"))


@query("verification_verdicts", NO_CTE + """WITH c AS (SELECT l_orderkey, l_linenumber % 2 = 0 AS head, l_returnflag = 'R' AS failed, l_quantity > 48 AS blocked FROM lineitem),
o AS (SELECT l_orderkey, head, CASE WHEN bool_or(blocked) THEN 'unknown' WHEN bool_or(failed) THEN 'failed' ELSE 'passed' END AS outcome FROM c GROUP BY 1, 2)
SELECT o_orderkey AS change, CASE WHEN b.outcome IS NULL THEN CASE h.outcome WHEN 'passed' THEN 'verified' WHEN 'failed' THEN 'failed' ELSE 'inconclusive' END WHEN h.outcome = 'passed' AND b.outcome IN ('passed', 'failed') THEN 'verified' WHEN h.outcome = 'failed' AND b.outcome = 'passed' THEN 'failed' ELSE 'inconclusive' END AS verdict
FROM orders LEFT JOIN o b ON b.l_orderkey = o_orderkey AND NOT b.head LEFT JOIN o h ON h.l_orderkey = o_orderkey AND h.head""")
def verification_verdicts(spark, d):
    """Orders as changes; odd lines as checks at the baseline, even ones at the head."""
    li = read(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 2 == 0).alias("head"), (F.col("l_returnflag") == "R").alias("failed"), (F.col("l_quantity") > 48).alias("blocked"))
    o = states.outcome(li, "l_orderkey", "head")
    both = o.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(F.when(~F.col("head"), F.col("outcome"))).alias("b"), F.max(F.when(F.col("head"), F.col("outcome"))).alias("h"))
    return read(spark, d, "orders").select("o_orderkey").join(both, "o_orderkey", "left").select(F.col("o_orderkey").alias("change"), states.verdict(F.col("b"), F.col("h")).alias("verdict"))


@query("accuracy_scores", NO_CTE + """WITH j AS (SELECT l_orderkey, l_suppkey, l_discount > 0.03 AS correct FROM lineitem), s AS (SELECT count(*) AS n, sum(correct::INT) AS r FROM j GROUP BY l_orderkey, l_suppkey),
a AS (SELECT sum(n)::BIGINT AS edges, sum(r)::BIGINT AS ok, count(*) AS sites, sum((r > 0)::INT)::BIGINT AS hit, sum((n = 1 AND r = 1)::INT)::BIGINT AS strict FROM s),
m AS (SELECT 'precision' AS measure, ok AS k, edges AS n FROM a UNION ALL SELECT 'recall', hit, sites FROM a UNION ALL SELECT 'strict', strict, sites FROM a),
w AS (SELECT measure, k / n AS value, (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS low, (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS high FROM m
 UNION ALL SELECT 'f1', 2 * (ok / edges) * (hit / sites) / (ok / edges + hit / sites), NULL, NULL FROM a)
SELECT measure, floor(value * 1e6 + 0.5) / 1e6 AS value, floor(low * 1e6 + 0.5) / 1e6 AS low, floor(high * 1e6 + 0.5) / 1e6 AS high FROM w""")
def accuracy_scores(spark, d):
    j = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", (F.col("l_discount") > 0.03).alias("correct"))
    s = states.scores(j, "l_orderkey", "l_suppkey")
    return s.select("measure", micro(F.col("value"), "value"), micro(F.col("low"), "low"), micro(F.col("high"), "high"))


@query("merged_seeds", NO_CTE + "SELECT p_brand AS fqn, min(p_size % 9)::INT AS source, max(p_retailprice) AS strength FROM part GROUP BY 1")
def merged_seeds(spark, d):
    offers = read(spark, d, "part").select(F.col("p_brand").alias("fqn"), (F.col("p_size") % 9).cast("int").alias("source"), F.col("p_retailprice").alias("strength"))
    return states.merged_seeds(offers)


@query("fact_intactness", NO_CTE + """WITH a AS (SELECT 'arch.' || o_custkey AS fact_key, 'p/' || o_orderkey AS path, CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority END AS fqn, o_orderstatus AS sig_hash, CASE WHEN o_orderkey % 5 > 0 THEN 'b' END AS body_hash FROM orders),
s AS (SELECT DISTINCT 'p/' || o_orderkey AS path, o_orderpriority AS fqn, o_orderstatus AS sig_hash, CASE WHEN o_orderkey % 5 > 0 THEN CASE WHEN o_orderkey % 40 = 1 THEN 'c' ELSE 'b' END END AS body_hash FROM orders WHERE o_orderkey % 30 <> 7)
SELECT fact_key, bool_and(EXISTS (SELECT 1 FROM s WHERE s.path = a.path AND (a.fqn IS NULL OR (s.fqn = a.fqn AND s.sig_hash = a.sig_hash AND s.body_hash = a.body_hash)))) AS intact FROM a GROUP BY fact_key""")
def fact_intactness(spark, d):
    """Orders as anchors of a fact for each customer; some are gone, of some the body has moved, some never had one, and some name no symbol."""
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    path = F.concat(F.lit("p/"), k.cast("string")).alias("path")
    cols = [path, F.col("o_orderpriority").alias("fqn"), F.col("o_orderstatus").alias("sig_hash")]
    anchors = o.select(F.concat(F.lit("arch."), F.col("o_custkey").cast("string")).alias("fact_key"), path, F.when(k % 13 > 0, F.col("o_orderpriority")).alias("fqn"), cols[2], F.when(k % 5 > 0, "b").alias("body_hash"))
    now = o.where(k % 30 != 7).select(*cols, F.when(k % 5 > 0, F.when(k % 40 == 1, "c").otherwise("b")).alias("body_hash"))
    return states.intact_facts(anchors, now)


@query("name_forms", """, f AS (SELECT fqn, parent_fqn, file_path, 'a b/' || fqn || '..Ü' AS label, CASE start_line % 4 WHEN 0 THEN './src/' || replace(file_path, '.ts', '.py') WHEN 1 THEN 'm/src/' || file_path ELSE file_path || 'x' END AS path FROM symbols)
SELECT fqn, regexp_replace(lower(substr(regexp_replace(regexp_replace(label, '[^A-Za-z0-9]+', '-', 'g'), '^-', ''), 1, 60)), '-+$', '') AS label_slug, trim(lower(replace(regexp_replace(label, '[^\\p{L}\\p{N}]', '-', 'g'), 'Ü', '~')), '-') AS slugged,
 CASE WHEN contains(path, '/src/') THEN split_part(path, '/src/', 1) ELSE '' END AS module, regexp_replace(path, '\\.(tsx|ts|mts|cts|jsx|js|mjs|cjs)$', '') AS script,
 array_to_string(list_filter(string_split(regexp_replace(regexp_replace(path, '^\\./', ''), '\\.py$', ''), '/'), lambda x: x NOT IN ('', '__init__', 'src')), '.') AS python, list_last(string_split(coalesce(parent_fqn, fqn), '.')) AS component,
 regexp_replace(split_part(regexp_replace(fqn, '^.*#', ''), '(', 1), '^.*\\.', '') AS segment FROM f""")
def name_forms(spark, d):
    label = F.concat(F.lit("a b/"), "fqn", F.lit("..Ü"))
    k = F.col("start_line") % 4
    path = F.when(k == 0, F.concat(F.lit("./src/"), F.replace("file_path", F.lit(".ts"), F.lit(".py")))).when(k == 1, F.concat(F.lit("m/src/"), "file_path")).otherwise(F.concat("file_path", F.lit("x")))
    s = derive.symbols(spark, d).withColumns({"label": label, "path": path})
    p, fqn = F.col("path"), F.col("fqn")
    return s.select("fqn", N.label_slug(F.col("label")).alias("label_slug"), F.replace(N.slugify(F.col("label")), F.lit("Ü"), F.lit("~")).alias("slugged"), N.module_of(p).alias("module"), N.script_module(p).alias("script"), N.python_module(p).alias("python"), N.component(fqn, F.col("parent_fqn")).alias("component"), N.seed_segment(fqn).alias("segment"))


@query("text_classes", NO_CTE + """WITH k AS (SELECT p_partkey, p_size, ['arch.x', 'task.y', 'nope.z', 'plain', 'risk.'][(p_partkey % 5 + 1)::INT] AS key, ['@app.get("/a/' || p_size || '")', '@router.post(''/b'')', '@fixture', '@app.route("x")', 'x.PUT( "/c", y)'][(p_partkey % 5 + 1)::INT] AS decorator,
 ['selected: best', 'budget exhausted', 'score below floor', 'at most 3', 'no anchor left', ''][(p_partkey % 6 + 1)::INT] AS reason, ['v' || p_size || '.2.1-x', 'none', 'a 1. b', 'end ' || p_size || '.7.', '.5'][(p_partkey % 5 + 1)::INT] AS line FROM part)
SELECT p_partkey, CASE WHEN contains(key, '.') THEN split_part(key, '.', 1) ELSE 'other' END AS space, CASE p_partkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'task is no namespace' WHEN 2 THEN 'unknown namespace' WHEN 3 THEN 'no namespace' ELSE 'only a namespace' END AS refused,
 CASE p_partkey % 5 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 4 THEN 'PUT' END AS verb, CASE p_partkey % 5 WHEN 0 THEN '/a/' || p_size WHEN 1 THEN '/b' WHEN 4 THEN '/c' END AS route, ['selected', 'budget exhausted', 'below floor', 'component cap', 'no anchor', 'other'][(p_partkey % 6 + 1)::INT] AS reason,
 CASE p_partkey % 5 WHEN 0 THEN p_size || '.2.1' WHEN 2 THEN '1' WHEN 3 THEN p_size || '.7' WHEN 4 THEN '.5' END AS version FROM k""")
def text_classes(spark, d):
    """Fact keys, route decorators, reasons and versions in lines."""
    i, size = F.col("p_partkey"), F.col("p_size").cast("string")

    def pick(*of):
        return F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in of]), (i % len(of) + 1).cast("int"))

    key = pick("arch.x", "task.y", "nope.z", "plain", "risk.")
    decorator = pick(F.concat(F.lit('@app.get("/a/'), size, F.lit('")')), "@router.post('/b')", "@fixture", '@app.route("x")', 'x.PUT( "/c", y)')
    reason = pick("selected: best", "budget exhausted", "score below floor", "at most 3", "no anchor left", "")
    line = pick(F.concat(F.lit("v"), size, F.lit(".2.1-x")), "none", "a 1. b", F.concat(F.lit("end "), size, F.lit(".7.")), ".5")
    verb, route = N.route_of(decorator)
    return read(spark, d, "part").select("p_partkey", N.namespace_of(key).alias("space"), N.check_key(key).alias("refused"), verb.alias("verb"), route.alias("route"), N.reason_class(reason).alias("reason"), N.extract_version(line).alias("version"))


REPORT = """, imp AS ({impact}), sy AS (SELECT fqn, min(struct_pack(kind := kind, file_path := file_path, start_line := start_line)) AS s FROM symbols GROUP BY 1),
x AS (SELECT fqn, s.kind AS kind, s.file_path AS file_path, s.start_line AS start_line, score, depth, contains(s.file_path, '/test/') OR contains(s.file_path, '/tests/') OR regexp_matches(s.file_path, '\\.(test\\.ts|test\\.tsx|spec\\.ts)$') OR contains(fqn, 'Test#') OR regexp_matches(fqn, 'Tests?$') AS test FROM imp JOIN sy USING (fqn))
SELECT * EXCLUDE (r), {reverse} AND (SELECT count(*) FILTER (test) = 0 AND count(*) > 0 FROM x) AS uncovered FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY score DESC, fqn) AS r FROM x) WHERE test OR r <= {limit}"""


def report_sql(reverse: bool, of: tuple[str, ...], limit: int) -> str:
    views, _, last = impact_sql(reverse, of).rpartition("\nSELECT ")
    return views + REPORT.format(impact="SELECT " + last, reverse=str(reverse).lower(), limit=limit)


@query("impact_report", report_sql(True, SEEDS, 40))
def impact_report(spark, d):
    """What two nations' dependents are: none is a test, so the report is uncovered."""
    e, s = derive.graph_tables(spark, d)
    return graph.report(graph.impact(e, seeds(spark, *SEEDS), s), s, 40)


@query("impact_report_forward", report_sql(False, FORWARD, 10))
def impact_report_forward(spark, d):
    e, s = derive.graph_tables(spark, d)
    reached = graph.impact(e, seeds(spark, *FORWARD), s, reverse=False)
    return graph.report(reached, s, 10, reverse=False)


@query("soft_delete", "SELECT file_path, count(*) AS n, sum((deleted OR ends_with(file_path, '.ts'))::INT)::BIGINT AS gone FROM symbols GROUP BY 1")
def soft_delete(spark, d):
    """Symbols of deleted files are deleted; here all scripts go."""
    s = derive.symbols(spark, d)
    files = s.select(F.col("file_path").alias("path"), F.lit(False).alias("deleted")).distinct()
    _, after = incremental.mark_deleted(files, s, files.where(F.col("path").endswith(".ts")).select("path"))
    return after.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("deleted").cast("int")).alias("gone"))


EDGE_FILES = """, e AS (SELECT e.src, e.dst, e.edge_type, s.file_path FROM edges e JOIN symbols s ON s.fqn = e.src), inc AS (SELECT src, dst || '!' AS dst, edge_type, file_path FROM e WHERE contains(file_path, 'y1998'))
"""


@query("replace_edges", EDGE_FILES + "SELECT edge_type, ends_with(dst, '!') AS fresh, count(*) AS n FROM (SELECT * FROM e WHERE file_path NOT IN (SELECT file_path FROM inc) UNION ALL SELECT * FROM inc WHERE src IN (SELECT fqn FROM symbols WHERE NOT deleted)) GROUP BY 1, 2")
def replace_edges(spark, d):
    """The files of one year supply their edges anew."""
    s = derive.symbols(spark, d)
    e = derive.edges(spark, d).join(s.select(F.col("fqn").alias("src"), "file_path"), "src").select("src", "dst", "edge_type", "file_path")
    incoming = e.where(F.col("file_path").contains("y1998")).withColumn("dst", F.concat("dst", F.lit("!")))
    return incremental.replace_edges(e, incoming, s).groupBy("edge_type", F.col("dst").endswith("!").alias("fresh")).agg(F.count(F.lit(1)).alias("n"))


@query("ledger_append", NO_CTE + "SELECT user_id, event_type, event_id < 500 AS old FROM (SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type)")
def ledger_append(spark, d):
    """The first 500 events as the ledger by user and type, one row each; all events come in, and only new keys stay."""
    e = read(spark, d, "events").select("user_id", "event_type", (F.col("event_id") < 500).alias("old"))
    ledger = e.where("old").distinct()
    return incremental.append_once(ledger, e.where("NOT old"), "user_id", "event_type")


@query("display_ids", NO_CTE + "SELECT p_partkey, 'F-' || ((SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND b.p_partkey % 2 = 0) + row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)) AS uid FROM part a WHERE p_partkey % 2 = 1")
def display_ids(spark, d):
    """Even parts of a brand have numbers from 1; odd ones get those after them."""
    p = read(spark, d, "part").select("p_partkey", "p_brand")
    none = p.where("false").select("p_brand", F.lit("").alias("uid"))
    stored = incremental.display_ids(none, p.where("p_partkey % 2 = 0"), "p_brand", "F-", "p_partkey").select("p_brand", "uid")
    return incremental.display_ids(stored, p.where("p_partkey % 2 = 1"), "p_brand", "F-", "p_partkey").select("p_partkey", "uid")


@query("aliases", NO_CTE + """WITH RECURSIVE r AS (SELECT o_orderkey AS o, o_orderkey + o_custkey AS n FROM orders WHERE o_orderkey % 3 > 0 AND o_custkey > 0), f(fqn, now, k) AS (SELECT o_orderkey, o_orderkey, 0 FROM orders UNION ALL SELECT fqn, n, k + 1 FROM f JOIN r ON o = now WHERE k < 16)
SELECT 'n' || fqn AS fqn, 'n' || first(now ORDER BY k DESC) AS now FROM f GROUP BY fqn""")
def aliases(spark, d):
    """Two of three orders are renamed, to a name that many other orders have, and may be renamed again."""
    o = read(spark, d, "orders")
    text = lambda c: F.concat(F.lit("n"), c.cast("string"))
    renamed = o.where("o_orderkey % 3 > 0 AND o_custkey > 0").select(text(F.col("o_orderkey")).alias("old_fqn"), text(F.col("o_orderkey") + F.col("o_custkey")).alias("new_fqn"))
    return incremental.alias_of(renamed, o.select(text(F.col("o_orderkey")).alias("fqn")))
