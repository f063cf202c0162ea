"""The registered queries of the graph model over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names as N
from ..functions.words import STOPWORDS
from ..operators import evaluation, graph, incremental, lookup, ranking, resolve, states, views
from . import derive
from .derive import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEEDS = ("geo.ASIA.NATION_2", "geo.EUROPE.NATION_3")
FORWARD = ("sales.y1998#order_0(P)", "sales.y1997#order_1(F)", "sales.y1999#order_2(O)")
NO_CTE = "plain "


def query(name: str, sql: str | None = None):
    """Registers a query; its SQL may use the derived views (symbols, edges, hints, weights)."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql.removeprefix(NO_CTE) if sql.startswith(NO_CTE) else f"WITH RECURSIVE {derive.SQL} {sql}"
        return f

    return put


def micro(c, name: str):
    return (F.floor(c * 1e6 + 0.5) / 1e6).alias(name)


def seeds(spark: SparkSession, *fqns: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in fqns], "fqn string")


# ---- traversal

STEPS = """, steps AS (SELECT {a} AS node, {b} AS nxt, edge_type, confidence, weight FROM edges JOIN weights ON wt = edge_type WHERE {b} IN (SELECT fqn FROM symbols WHERE NOT deleted)),
cap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY confidence DESC, nxt, edge_type) AS r FROM steps) WHERE r <= {cap}),
l0 AS (SELECT unnest([{seeds}]) AS node, 1.0::DOUBLE AS val, 1.0::DOUBLE AS least, '' AS path, '' AS edge_type),
{levels}
reached AS (SELECT *, 0 AS depth FROM l0 WHERE false{union}), best AS (SELECT * FROM reached QUALIFY row_number() OVER (PARTITION BY node ORDER BY val DESC, depth) = 1)
"""


def steps_sql(reverse: bool, of: tuple[str, ...] = SEEDS, depth: int = 5, cap: int = 200) -> str:
    """Views of a traversal level by level; an arrival must be above all earlier ones of its node."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    levels = ""
    for k in range(1, depth + 1):
        before = " UNION ALL ".join(f"SELECT node, val FROM l{i}" for i in range(k))
        levels += f"""m{k} AS (SELECT nxt AS node, val * weight * confidence AS val, least(least, confidence) AS least, path || l.node || ' -' || cap.edge_type || '-> ' AS path, cap.edge_type, row_number() OVER (PARTITION BY nxt ORDER BY val * weight * confidence DESC, l.node, cap.edge_type, confidence DESC, least) AS r FROM l{k - 1} l JOIN cap ON cap.node = l.node WHERE val * weight * confidence >= 0.15 AND nxt NOT IN (SELECT node FROM l0)),
l{k} AS (SELECT m.node, m.val, least, path, edge_type FROM m{k} m LEFT JOIN (SELECT node, max(val) AS had FROM ({before}) GROUP BY node) b ON b.node = m.node WHERE r = 1 AND (had IS NULL OR m.val > had)),
"""
    union = "".join(f" UNION ALL SELECT *, {k} FROM l{k}" for k in range(1, depth + 1))
    return STEPS.format(a=a, b=b, cap=cap, seeds=", ".join(f"'{x}'" for x in of), levels=levels, union=union)


def impact_sql(reverse: bool, of: tuple[str, ...] = SEEDS, depth: int = 5) -> str:
    return steps_sql(reverse, of, depth) + "\nSELECT node AS fqn, floor(val * 1000 + 0.5) / 1000 AS score, depth::INT AS depth FROM best"


@query("impact_reverse", impact_sql(True))
def impact_reverse(spark, d):
    e, s = derive.graph_tables(spark, d)
    return graph.impact(e, seeds(spark, *SEEDS), s)


@query("impact_forward", impact_sql(False, FORWARD))
def impact_forward(spark, d):
    e, s = derive.graph_tables(spark, d)
    return graph.impact(e, seeds(spark, *FORWARD), s, reverse=False)


WAY = "SELECT {more}node AS fqn, floor(val * 1000 + 0.5) / 1000 AS score, depth::INT AS depth, least AS min_confidence, path FROM best"


def ways(found: DataFrame) -> DataFrame:
    return found.select("fqn", graph.thousandths(F.col("score")).alias("score"), "depth", "min_confidence", graph.path_text(F.col("path")).alias("path"))


@query("impact_paths", steps_sql(True, SEEDS, cap=40) + WAY.format(more=""))
def impact_paths(spark, d):
    """The best way to each dependent, with its least confidence; nodes of more than 40 edges are cut to their best."""
    e, s = derive.graph_tables(spark, d)
    return ways(graph.traverse(e, seeds(spark, *SEEDS), s, cap=40).reached)


@query("impact_truncated", steps_sql(True, SEEDS, cap=40) + "SELECT node AS fqn, depth::INT AS depth, count(*) AS edges FROM (SELECT node, depth FROM reached WHERE depth < 5 UNION ALL SELECT node, 0 FROM l0) f JOIN steps USING (node) GROUP BY 1, 2 HAVING count(*) > 40".replace("depth::INT AS depth", "(depth + 1)::INT AS depth"))
def impact_truncated(spark, d):
    """Where the fan-out cap of 40 bound, and how many edges there were."""
    e, s = derive.graph_tables(spark, d)
    return graph.traverse(e, seeds(spark, *SEEDS), s, cap=40).truncated


@query("impact_crossed", steps_sql(True, SEEDS).replace("FROM edges JOIN weights", "FROM (SELECT src, dst, CASE WHEN edge_type = 'calls' THEN 'calls_http' ELSE edge_type END AS edge_type, confidence FROM edges) JOIN weights") + "SELECT count(*) FILTER (edge_type IN ('calls_graphql', 'calls_http')) AS crossed, count(DISTINCT node) AS visited FROM reached")
def impact_crossed(spark, d):
    """How many arrivals came over a seam, calls taken as calls between services."""
    e, s = derive.graph_tables(spark, d)
    e = e.withColumn("edge_type", F.when(F.col("edge_type") == "calls", "calls_http").otherwise(F.col("edge_type")))
    found = graph.traverse(e, seeds(spark, *SEEDS), s)
    return found.reached.agg(F.lit(found.crossed).cast("long").alias("crossed"), F.count(F.lit(1)).alias("visited"))


def expand_sql() -> str:
    both = [f"WITH RECURSIVE {derive.SQL} {steps_sql(reverse, FORWARD)} {WAY.format(more='')}" for reverse in (True, False)]
    return f"SELECT fqn, score, depth, min_confidence, path FROM (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY score DESC, second) AS r FROM (SELECT 0 AS second, * FROM ({both[0]}) UNION ALL SELECT 1, * FROM ({both[1]}))) WHERE r = 1"


@query("expand_both", NO_CTE + expand_sql())
def expand_both(spark, d):
    """What an explanation of three orders looks at: both directions, each symbol by its better way."""
    e, s = derive.graph_tables(spark, d)
    return ways(graph.expand(e, seeds(spark, *FORWARD), "explain", s).reached)


@query("fan_out_cap", """, r AS (SELECT dst AS node, src AS nxt, edge_type, confidence, row_number() OVER (PARTITION BY dst ORDER BY confidence DESC, src, edge_type) AS r FROM edges)
SELECT node, count(*) AS n, min(confidence) AS least FROM r WHERE r <= 20 GROUP BY node""")
def fan_out_cap(spark, d):
    steps = graph.capped(graph.weighted(derive.edges(spark, d)), 20)
    return steps.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("confidence").alias("least"))


@query("reachable", """, r(fqn, depth) AS (SELECT 'geo.ASIA' AS fqn, 0 AS depth UNION SELECT src, depth + 1 FROM r JOIN edges ON dst = fqn WHERE depth < 3 AND src IN (SELECT fqn FROM symbols WHERE NOT deleted))
SELECT fqn, min(depth)::INT AS depth FROM r WHERE fqn <> 'geo.ASIA' GROUP BY fqn""")
def reachable(spark, d):
    e, s = derive.graph_tables(spark, d)
    return graph.reachable(e, seeds(spark, "geo.ASIA"), 3, s)


@query("supertypes", """, p AS (SELECT DISTINCT src AS fqn, dst AS ancestor FROM edges WHERE edge_type IN ('extends', 'implements')),
r(fqn, ancestor, depth) AS (SELECT fqn, ancestor, 1 FROM p UNION SELECT r.fqn, p.ancestor, depth + 1 FROM r JOIN p ON p.fqn = r.ancestor WHERE depth < 8)
SELECT fqn, ancestor, min(depth)::INT AS depth FROM r GROUP BY fqn, ancestor""")
def supertypes(spark, d):
    return graph.supertypes(derive.edges(spark, d))


@query("symbol_detail", """, nm(asked, fqn) AS (VALUES ('geo.ASIA.NATION_2', 'geo.ASIA.NATION_2'), ('old.ASIA', 'geo.ASIA')) SELECT asked, fqn, 'in' AS way, edge_type, src AS other, confidence FROM edges JOIN nm ON dst = fqn WHERE src IN (SELECT fqn FROM symbols WHERE NOT deleted) UNION ALL SELECT asked, fqn, 'out', edge_type, dst, confidence FROM edges JOIN nm ON src = fqn WHERE dst IN (SELECT fqn FROM symbols WHERE NOT deleted)""")
def symbol_detail(spark, d):
    """The neighbours of a class, and of a package asked for by the name it had two renames ago."""
    e, s = derive.graph_tables(spark, d)
    aliases = spark.createDataFrame([("old.ASIA", "mid.ASIA"), ("mid.ASIA", "geo.ASIA")], "old_fqn string, new_fqn string")
    return views.symbol_detail(s, e, seeds(spark, SEEDS[0], "old.ASIA", "gone.X"), aliases)


# ---- projections and predicates


@query("live_symbols", "SELECT kind, count(*) AS n FROM symbols WHERE NOT deleted GROUP BY kind")
def live_symbols(spark, d):
    return derive.symbols(spark, d).where(~F.col("deleted")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


FILES = ", files AS (SELECT file_path AS path, CASE WHEN file_path LIKE '%.ts' THEN 'typescript' ELSE 'java' END AS lang, bool_and(deleted) AS deleted FROM symbols GROUP BY 1)"


def files(symbols: DataFrame) -> DataFrame:
    """``path, lang, deleted`` of the files of symbols; a file is deleted if all it has is."""
    by = symbols.groupBy(F.col("file_path").alias("path")).agg(F.min(F.col("deleted").cast("int")).cast("boolean").alias("deleted"))
    return by.select("path", F.when(F.col("path").endswith(".ts"), "typescript").otherwise("java").alias("lang"), "deleted")


@query("file_facts", FILES + " SELECT path, lang FROM files WHERE NOT deleted")
def file_facts(spark, d):
    return views.file_facts(files(derive.symbols(spark, d)))


@query("test_and_frontend", """SELECT contains(file_path, '/test/') OR contains(file_path, '/tests/') OR ends_with(file_path, '.test.ts') OR ends_with(file_path, '.test.tsx') OR ends_with(file_path, '.spec.ts') OR contains(fqn, 'Test#') OR ends_with(fqn, 'Test') OR ends_with(fqn, 'Tests') AS is_test,
 file_path LIKE '%.ts' OR file_path LIKE '%.tsx' OR file_path LIKE '%.jsx' OR file_path LIKE '%.js' AS is_frontend, count(*) AS n FROM (SELECT replace(rtrim(replace(file_path || '/', '.ts/', CASE WHEN start_line % 2 = 0 THEN '.spec.ts/' ELSE '.ts/' END), '/'), 'geo/ASIA/', 'geo/tests/') AS file_path, CASE WHEN ends_with(fqn, '_7') THEN fqn || 'Test' ELSE fqn END AS fqn FROM symbols) GROUP BY 1, 2""")
def test_and_frontend(spark, d):
    path = F.rtrim(F.replace(F.concat("file_path", F.lit("/")), F.lit(".ts/"), F.when(F.col("start_line") % 2 == 0, ".spec.ts/").otherwise(".ts/")), F.lit("/"))
    s = derive.symbols(spark, d).select(F.when(F.col("fqn").endswith("_7"), F.concat("fqn", F.lit("Test"))).otherwise(F.col("fqn")).alias("fqn"), F.replace(path, F.lit("geo/ASIA/"), F.lit("geo/tests/")).alias("file_path"))
    return s.groupBy(N.is_test(F.col("file_path"), F.col("fqn")).alias("is_test"), N.is_frontend(F.col("file_path")).alias("is_frontend")).agg(F.count(F.lit(1)).alias("n"))


@query("body_change_edges", "SELECT edge_type, edge_type IN ('reads', 'writes', 'persists', 'emits', 'calls', 'calls_graphql', 'calls_http') AS body, count(*) AS n FROM edges GROUP BY 1, 2")
def body_change_edges(spark, d):
    return derive.edges(spark, d).groupBy("edge_type", F.col("edge_type").isin(*graph.BODY).alias("body")).agg(F.count(F.lit(1)).alias("n"))


NAMED = "(fqn = '{0}' OR ends_with(lower(fqn), lower('{0}')) OR contains(lower(fqn), lower('{0}') || '(') OR name = '{0}')"
LIVE = ", live AS (SELECT *, regexp_replace(split_part(regexp_replace(fqn, '^.*#', ''), '(', 1), '^.*\\.', '') AS name FROM symbols WHERE NOT deleted) "


@query("find_symbols", LIVE + "SELECT * FROM (SELECT 'name' AS how, fqn FROM live WHERE " + NAMED.format("Customer_1") + " ORDER BY length(fqn), fqn LIMIT 25) UNION ALL SELECT * FROM (SELECT 'path', fqn FROM live WHERE file_path = 'geo/ASIA/NATION_2.java' ORDER BY start_line, fqn LIMIT 25) UNION ALL SELECT * FROM (SELECT 'word', fqn FROM live WHERE " + NAMED.format("supplier_1") + " OR contains(lower(name), 'supplier_1') ORDER BY " + NAMED.format("supplier_1") + " DESC, length(fqn), fqn LIMIT 5)")
def find_symbols(spark, d):
    """Symbols by the end of a name, by a path, and by a word."""
    s = derive.symbols(spark, d)
    of = lambda how, df: df.select(F.lit(how).alias("how"), "fqn")
    return of("name", lookup.find_symbols(s, "Customer_1")).unionByName(of("path", lookup.find_symbols(s, "geo/ASIA/NATION_2.java"))).unionByName(of("word", lookup.find_by_word(s, "supplier_1", 5)))


@query("target_states", LIVE + "SELECT 'geo.ASIA' AS target, 'one' AS state, 'geo.ASIA' AS fqn UNION ALL SELECT 'nothing', 'not_found', NULL UNION ALL SELECT '(FURNITURE)', 'ambiguous', fqn FROM (SELECT fqn FROM live WHERE ends_with(lower(fqn), '(furniture)') ORDER BY length(fqn), fqn LIMIT 25) UNION ALL SELECT 'geo/ASIA/NATION_2.java', 'one', fqn FROM (SELECT fqn FROM live WHERE file_path = 'geo/ASIA/NATION_2.java' ORDER BY start_line, fqn LIMIT 25)")
def target_states(spark, d):
    """A full name, an unknown one, an ending of many names, and a path."""
    s, out = derive.symbols(spark, d), None
    for target in ("geo.ASIA", "nothing", "(FURNITURE)", "geo/ASIA/NATION_2.java"):
        one = lookup.target_state(s, target).select(F.lit(target).alias("target"), "state", "fqn")
        out = one if out is None else out.unionByName(one)
    return out


@query("members_of", "SELECT fqn FROM symbols WHERE NOT deleted AND (starts_with(fqn, 'geo.ASIA.NATION_2#') OR starts_with(fqn, 'geo.ASIA.NATION_2.') OR starts_with(fqn, 'geo.ASIA.NATION_2::'))")
def members_of(spark, d):
    return lookup.members_of(derive.symbols(spark, d), SEEDS[0]).select("fqn")


@query("symbol_at", """, places AS (SELECT DISTINCT s.file_path, s.start_line + e.site_line AS line FROM edges e JOIN symbols s ON s.fqn = e.src), spans AS (SELECT *, start_line + 20 + start_line % 60 AS end_line FROM symbols WHERE NOT deleted)
SELECT file_path, line, fqn FROM (SELECT q.file_path, q.line, s.fqn, row_number() OVER (PARTITION BY q.file_path, q.line ORDER BY s.end_line - s.start_line, s.fqn) AS r FROM places q JOIN spans s ON s.file_path = q.file_path AND q.line BETWEEN s.start_line AND s.end_line) WHERE r = 1""")
def symbol_at(spark, d):
    """The innermost symbol at the site of every edge."""
    s = derive.symbols(spark, d).withColumn("end_line", F.col("start_line") + 20 + F.col("start_line") % 60)
    places = derive.edges(spark, d).join(s.select(F.col("fqn").alias("src"), "file_path", "start_line"), "src").select("file_path", (F.col("start_line") + F.col("site_line")).alias("line"))
    return lookup.symbol_at(s, places)


# ---- joins and set operations


@query("edges_into", "SELECT e.dst AS fqn, e.src AS other, s.kind, s.file_path, s.start_line, e.edge_type, e.confidence, e.site_line FROM edges e JOIN symbols s ON s.fqn = e.src AND NOT s.deleted WHERE e.dst IN ('geo.ASIA.NATION_2', 'geo.EUROPE.NATION_3')")
def edges_into(spark, d):
    return views.edges_into(derive.symbols(spark, d), derive.edges(spark, d), seeds(spark, *SEEDS))


@query("edges_out", "SELECT e.src AS fqn, e.dst AS other, s.kind, s.file_path, s.start_line, e.edge_type, e.confidence, e.site_line FROM edges e JOIN symbols s ON s.fqn = e.dst AND NOT s.deleted JOIN symbols o ON o.fqn = e.src AND o.start_line % 50 = 3")
def edges_out(spark, d):
    s = derive.symbols(spark, d)
    return views.edges_out(s, derive.edges(spark, d), s.where("start_line % 50 = 3"))


@query("edge_facts", "SELECT edge_type, dst IN (SELECT fqn FROM symbols WHERE NOT deleted) AS there, count(*) AS n, count(DISTINCT src) AS sources FROM edges WHERE src IN (SELECT fqn FROM symbols WHERE NOT deleted) GROUP BY 1, 2")
def edge_facts(spark, d):
    s = derive.symbols(spark, d)
    return views.edge_facts(s, derive.edges(spark, d)).groupBy("edge_type", F.col("dst").isNotNull().alias("there")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("src").alias("sources"))


@query("all_edges", ", t AS (SELECT fqn, kind FROM symbols WHERE NOT deleted) SELECT a.kind AS src_kind, b.kind AS dst_kind, e.edge_type, count(*) AS n FROM edges e JOIN t a ON a.fqn = e.src LEFT JOIN t b ON b.fqn = e.dst GROUP BY 1, 2, 3")
def all_edges(spark, d):
    t = derive.symbols(spark, d).where(~F.col("deleted")).select("fqn", "kind")
    a, b = t.select(F.col("fqn").alias("src"), F.col("kind").alias("src_kind")), t.select(F.col("fqn").alias("dst"), F.col("kind").alias("dst_kind"))
    return derive.edges(spark, d).join(a, "src").join(b, "dst", "left").groupBy("src_kind", "dst_kind", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@query("symbol_facts", "SELECT c.fqn, c.kind, c.file_path, c.start_line, c.parent_fqn AS parent_fqn, p.kind AS parent_kind FROM (SELECT c.* EXCLUDE (parent_fqn), p.fqn AS parent_fqn FROM symbols c LEFT JOIN symbols p ON p.fqn = c.parent_fqn) c LEFT JOIN symbols p ON p.fqn = c.parent_fqn WHERE NOT c.deleted")
def symbol_facts(spark, d):
    return views.symbol_facts(derive.symbols(spark, d))


@query("neighbours_of_files", """, paths AS (SELECT DISTINCT file_path AS path FROM symbols WHERE file_path IN ('geo/ASIA/NATION_2.java', 'geo/ASIA/NATION_2.ts', 'geo/EUROPE.ts')), own AS (SELECT fqn FROM symbols WHERE NOT deleted AND file_path IN (SELECT path FROM paths)),
n AS (SELECT fqn FROM own UNION SELECT src FROM edges WHERE dst IN (SELECT fqn FROM own) UNION SELECT dst FROM edges WHERE src IN (SELECT fqn FROM own)) SELECT c.fqn, c.kind, c.file_path, c.start_line, p.fqn AS parent_fqn, p.kind AS parent_kind FROM symbols c LEFT JOIN symbols p ON p.fqn = c.parent_fqn WHERE NOT c.deleted AND c.fqn IN (SELECT fqn FROM n)""")
def neighbours_of_files(spark, d):
    """The symbols of three files and those one edge away."""
    e, s = derive.graph_tables(spark, d)
    return views.symbol_facts_in(s, e, spark.createDataFrame([("geo/ASIA/NATION_2.java",), ("geo/ASIA/NATION_2.ts",), ("geo/EUROPE.ts",)], "path string"))


PACKAGE = "CASE WHEN contains({0}, '::') THEN regexp_extract({0}, '^(.*)::', 1) WHEN contains({0}, '.') THEN regexp_extract({0}, '^(.*)\\.', 1) ELSE '' END"
SIMPLE = "regexp_replace(regexp_replace(split_part({0}, '#', 1), '^.*::', ''), '^.*\\.', '') || CASE WHEN contains({0}, '#') THEN '#' || split_part(regexp_replace({0}, '^[^#]*#', ''), '(', 1) ELSE '' END"
RESOLVE_ANY = """, s AS (SELECT DISTINCT fqn FROM {symbols}), w AS (SELECT DISTINCT hint, CASE WHEN starts_with(hint, 'graphql:') THEN split_part({path}, '/', 1) ELSE '' END AS head FROM {hints}),
pk AS (SELECT DISTINCT """ + PACKAGE.format("split_part(fqn, '#', 1)") + """ AS pkg FROM s), pk2 AS (SELECT * FROM pk WHERE pkg <> ''),
own AS (SELECT root FROM (SELECT regexp_extract(pkg, '^[^.]*\\.[^.]*') AS root, count(*) AS n FROM pk2 WHERE contains(pkg, '.') GROUP BY 1) WHERE 2 * n > (SELECT count(*) FROM pk2 WHERE contains(pkg, '.'))),
pre AS (SELECT k, fqn, count(*) OVER (PARTITION BY k) AS n FROM (SELECT split_part(fqn, '(', 1) AS k, fqn FROM s WHERE contains(fqn, '('))),
sim AS (SELECT k, fqn, count(*) OVER (PARTITION BY k) AS n FROM (SELECT """ + SIMPLE.format("fqn") + """ AS k, fqn FROM s)),
mbr AS (SELECT k, fqn, count(*) OVER (PARTITION BY k) AS n FROM (SELECT split_part(regexp_replace(fqn, '^[^#]*#', ''), '(', 1) AS k, fqn FROM s WHERE contains(fqn, '#'))),
route AS (SELECT regexp_replace(fqn, '^(?:graphql:)(?:.*:)?', '') AS k, fqn, split_part(regexp_extract(fqn, '^graphql:(.*):', 1), '/', 1) AS module FROM s WHERE starts_with(fqn, 'graphql:')),
up(fqn, ancestor, depth) AS (SELECT fqn, ancestor, 1 FROM {supers} UNION SELECT up.fqn, p.ancestor, depth + 1 FROM up JOIN {supers} p ON p.fqn = up.ancestor WHERE depth < 8), up1 AS (SELECT fqn, ancestor, min(depth) AS depth FROM up WHERE fqn <> ancestor GROUP BY 1, 2),
g0 AS (SELECT w.hint, w.head, r.fqn, (module = head AND head <> '') AS near FROM w JOIN route r ON starts_with(w.hint, 'graphql:') AND r.k = regexp_replace(w.hint, '^(?:graphql:)(?:.*:)?', '')),
g1 AS (SELECT *, sum(near::INT) OVER (PARTITION BY hint, head) AS nn, count(*) OVER (PARTITION BY hint, head) AS n FROM g0), g2 AS (SELECT hint, head, fqn, CASE WHEN nn = 1 THEN 1 ELSE n END AS n FROM g1 WHERE nn <> 1 OR near),
i0 AS (SELECT w.hint, w.head, up1.depth, up1.ancestor, c.fqn FROM w JOIN up1 ON contains(w.hint, '#') AND up1.fqn = split_part(w.hint, '#', 1) JOIN (SELECT fqn AS k, fqn FROM s UNION SELECT k, fqn FROM pre WHERE n = 1) c ON c.k = up1.ancestor || '#' || regexp_replace(w.hint, '^[^#]*#', '')),
t AS (SELECT hint, head, fqn AS dst, CASE WHEN starts_with(hint, 'graphql:') THEN 'contract' ELSE 'exact' END AS tier, 0 AS rank, CASE WHEN starts_with(hint, 'graphql:') THEN 0.95 ELSE 1.0 END::DOUBLE AS confidence, CASE WHEN starts_with(hint, 'graphql:') THEN 'contract' ELSE 'exact' END AS resolution FROM w JOIN s ON s.fqn = w.hint
 UNION ALL SELECT hint, head, fqn, 'prefix', 1, 0.9::DOUBLE / n, 'heuristic' FROM w JOIN pre ON k = hint AND n <= 4
 UNION ALL SELECT hint, head, fqn, 'graphql', 2, CASE WHEN n = 1 THEN 0.95 ELSE 1.0::DOUBLE / n END, CASE WHEN n = 1 THEN 'contract' ELSE 'heuristic' END FROM g2
 UNION ALL SELECT hint, head, first(fqn ORDER BY depth, ancestor, fqn), 'inherited', 3, 0.85::DOUBLE, 'heuristic' FROM i0 GROUP BY hint, head
 UNION ALL SELECT hint, head, fqn, 'simple', 4, 0.7::DOUBLE, 'heuristic' FROM w JOIN sim ON n = 1 AND k = """ + SIMPLE.format("hint") + """
 UNION ALL SELECT hint, head, fqn, 'member', 5, 0.6::DOUBLE / n, 'heuristic' FROM w JOIN mbr ON n <= 4 AND k = regexp_replace(hint, '^#', '') AND NOT contains(regexp_replace(hint, '^#', ''), '#') AND NOT contains(hint, '(') AND NOT contains(hint, '::')),
best AS (SELECT * FROM (SELECT *, min(rank) OVER (PARTITION BY hint, head) AS top FROM t) WHERE rank = top),
hp AS (SELECT DISTINCT hint, """ + PACKAGE.format("split_part(hint, '#', 1)") + """ AS pkg FROM w),
o1 AS (SELECT hint, pkg FROM hp WHERE pkg <> '' AND pkg NOT IN (SELECT pkg FROM pk2)),
o2 AS (SELECT fqn, first(pkg ORDER BY depth, ancestor) AS pkg FROM (SELECT *, CASE WHEN contains(ancestor, '.') THEN regexp_extract(ancestor, '^(.*)\\.', 1) ELSE '' END AS pkg FROM up1) WHERE pkg <> '' AND pkg NOT IN (SELECT pkg FROM pk2) GROUP BY fqn),
o3 AS (SELECT * FROM o1 UNION ALL SELECT hint, o2.pkg FROM hp JOIN o2 ON o2.fqn = split_part(hint, '#', 1) WHERE hint NOT IN (SELECT hint FROM o1)),
place AS (SELECT hint, CASE WHEN pkg = (SELECT root FROM own) OR starts_with(pkg, (SELECT root FROM own) || '.') THEN 'sibling' ELSE 'external' END AS place FROM o3),
r AS (SELECT h.src, h.edge_type, h.site_line, h.hint, h.truth, b.dst, coalesce(b.tier, p.place, 'unresolved') AS tier, coalesce(b.resolution, p.place, 'unresolved') AS resolution, coalesce(b.confidence, 0)::DOUBLE AS confidence FROM {hints} h LEFT JOIN best b ON b.hint = h.hint AND b.head = CASE WHEN starts_with(h.hint, 'graphql:') THEN split_part({hpath}, '/', 1) ELSE '' END LEFT JOIN place p ON p.hint = h.hint)
"""
RESOLVE = RESOLVE_ANY.replace("{symbols}", "(SELECT fqn FROM symbols WHERE NOT deleted)").replace("{hints}", "hints").replace("{supers}", "supers").replace("{path}", "''").replace("{hpath}", "''")
TIERS = ("exact", "contract", "prefix", "graphql", "inherited", "simple", "member", "sibling", "external", "unresolved")


def resolved(spark, d):
    s = derive.symbols(spark, d)
    return resolve.resolve(derive.hints(derive.edges(spark, d)), s, derive.supers(s))


@query("resolve_ladder", RESOLVE + "SELECT edge_type, tier, resolution, count(*) AS n, count(DISTINCT dst) AS targets, floor(min(confidence) * 1e6 + 0.5) / 1e6 AS least FROM r GROUP BY 1, 2, 3")
def resolve_ladder(spark, d):
    """Every edge's hint, by tier: all tiers but GraphQL's, for which see ``resolve_graphql``."""
    return resolved(spark, d).groupBy("edge_type", "tier", "resolution").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("targets"), micro(F.min("confidence"), "least"))


ROUTES = """, rt AS (SELECT 'graphql:svc' || (p_partkey % 3) || '/backend:Query.' || p_brand || '_' || (p_size % 7) AS fqn FROM part UNION SELECT 'graphql:Query.only' || p_size FROM part UNION SELECT 'com.acme.core.T' || p_size || '#m' || p_size || '(int)' FROM part),
rh AS (SELECT 'c' || o_custkey AS src, 'calls_graphql' AS edge_type, 1 AS site_line, NULL AS truth, 'svc' || (o_orderkey % 4) || '/frontend/x.ts' AS src_path, CASE o_orderkey % 5 WHEN 0 THEN 'graphql:Query.only' || (o_orderkey % 60) WHEN 1 THEN 'com.acme.other.X' || (o_orderkey % 9) || '#go' WHEN 2 THEN 'com.acme.core.K' || (o_orderkey % 60) || '#m' || (o_orderkey % 60) ELSE 'graphql:Query.Brand#' || (o_custkey % 30) || '_' || (o_orderkey % 9) END AS hint FROM orders),
rs AS (SELECT DISTINCT 'com.acme.core.K' || p_size AS fqn, CASE WHEN p_size % 4 = 0 THEN 'com.acme.far.Base' WHEN p_size % 4 = 1 THEN 'javax.Base' ELSE 'com.acme.core.T' || p_size END AS ancestor FROM part)"""


@query("resolve_graphql", ROUTES + RESOLVE_ANY.replace("{symbols}", "rt").replace("{hints}", "rh").replace("{supers}", "rs").replace("{path}", "src_path").replace("{hpath}", "h.src_path") + "SELECT tier, resolution, count(*) AS n, count(DISTINCT dst) AS targets, floor(min(confidence) * 1e6 + 0.5) / 1e6 AS least, floor(sum(confidence) * 1e3 + 0.5) / 1e3 AS total FROM r GROUP BY 1, 2")
def resolve_graphql(spark, d):
    """Hints of GraphQL coordinates, siblings of the project's owner, and members inherited from inside and outside."""
    p, o = read(spark, d, "part"), read(spark, d, "orders")
    text = lambda c: c.cast("string")
    size = text(F.col("p_size"))
    routes = [F.concat(F.lit("graphql:svc"), text(F.col("p_partkey") % 3), F.lit("/backend:Query."), "p_brand", F.lit("_"), text(F.col("p_size") % 7)), F.concat(F.lit("graphql:Query.only"), size), F.concat(F.lit("com.acme.core.T"), size, F.lit("#m"), size, F.lit("(int)"))]
    symbols = p.select(F.explode(F.array(*routes)).alias("fqn")).distinct()
    k, up = F.col("o_orderkey"), F.col("p_size") % 4
    k60 = text(k % 60)
    hint = F.when(k % 5 == 0, F.concat(F.lit("graphql:Query.only"), k60)).when(k % 5 == 1, F.concat(F.lit("com.acme.other.X"), text(k % 9), F.lit("#go"))).when(k % 5 == 2, F.concat(F.lit("com.acme.core.K"), k60, F.lit("#m"), k60))
    hint = hint.otherwise(F.concat(F.lit("graphql:Query.Brand#"), text(F.col("o_custkey") % 30), F.lit("_"), text(k % 9)))
    hints = o.select(F.concat(F.lit("c"), text(F.col("o_custkey"))).alias("src"), F.lit("calls_graphql").alias("edge_type"), F.lit(1).alias("site_line"), F.concat(F.lit("svc"), text(k % 4), F.lit("/frontend/x.ts")).alias("src_path"), hint.alias("hint"))
    above = F.when(up == 0, "com.acme.far.Base").when(up == 1, "javax.Base").otherwise(F.concat(F.lit("com.acme.core.T"), size))
    r = resolve.resolve(hints, symbols, p.select(F.concat(F.lit("com.acme.core.K"), size).alias("fqn"), above.alias("ancestor")))
    return r.groupBy("tier", "resolution").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dst").alias("targets"), micro(F.min("confidence"), "least"), (F.floor(F.sum("confidence") * 1e3 + 0.5) / 1e3).alias("total"))


@query("edges_by_resolution", RESOLVE + ", site AS (SELECT src, site_line, hint, min(list_position([" + ", ".join(f"'{x}'" for x in TIERS) + "], tier) - 1) AS tier FROM r GROUP BY 1, 2, 3) SELECT tier::INT AS tier, count(*) AS n FROM site GROUP BY tier")
def edges_by_resolution(spark, d):
    tier = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) - 1
    return resolved(spark, d).groupBy("src", "site_line", "hint").agg(F.min(tier).cast("int").alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query("edge_accuracy", RESOLVE + """, j AS (SELECT r.tier, r.confidence, r.dst = h.truth AS correct FROM hints h JOIN (SELECT DISTINCT hint, dst, tier, confidence FROM r WHERE dst IS NOT NULL) r USING (hint)), b AS (SELECT tier, floor(confidence * 1000 + 0.5)::BIGINT AS claimed, count(*) AS n, sum(correct::INT)::BIGINT AS hits FROM j GROUP BY 1, 2),
c AS (SELECT *, (hits / n + 3.8416 / (2 * n) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS low, (hits / n + 3.8416 / (2 * n) + 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) AS high FROM b),
v AS (SELECT *, CASE WHEN n < 100 OR (high - low) / 2 > 0.15 THEN 'under_powered' WHEN claimed / 1000 < low OR claimed / 1000 > high THEN 'miscalibrated' ELSE 'ok' END AS verdict FROM c)
SELECT tier, claimed, n, floor(hits / n * 1e6 + 0.5) / 1e6 AS measured, floor(low * 1e6 + 0.5) / 1e6 AS low, floor(high * 1e6 + 0.5) / 1e6 AS high, verdict, CASE WHEN verdict = 'miscalibrated' THEN floor((hits + 0.5) / (n + 1) * 1e6 + 0.5) / 1e6 END AS proposed FROM v""")
def edge_accuracy(spark, d):
    h = derive.hints(derive.edges(spark, d))
    r = resolved(spark, d).where("dst IS NOT NULL")
    # an edge's hint may stand for several targets; each is judged against its own truth
    joined = h.join(r.select("hint", "dst", "tier", "confidence").distinct(), "hint")
    c = evaluation.calibration(joined.select("tier", "confidence", (F.col("dst") == F.col("truth")).alias("correct")))
    return c.select("tier", "claimed", "n", micro(F.col("measured"), "measured"), micro(F.col("low"), "low"), micro(F.col("high"), "high"), "verdict", micro(F.col("proposed"), "proposed"))


@query("edge_counts", RESOLVE + "SELECT count(*) AS sites, sum(hit)::BIGINT AS resolved, sum(ext)::BIGINT AS external, sum(sib)::BIGINT AS sibling, sum(gr)::BIGINT AS external_graph FROM (SELECT src, site_line, hint, max((dst IS NOT NULL AND place <> 'external-graph')::INT) AS hit, max((place = 'external')::INT) AS ext, max((place = 'sibling')::INT) AS sib, max((place = 'external-graph')::INT) AS gr FROM (SELECT *, CASE WHEN tier = 'member' AND site_line % 2 = 1 THEN 'external-graph' ELSE resolution END AS place FROM r) GROUP BY 1, 2, 3)")
def edge_counts(spark, d):
    """Call sites by how they ended; bare members at odd lines are taken as found in an external graph."""
    graph_too = F.when((F.col("tier") == "member") & (F.col("site_line") % 2 == 1), "external-graph").otherwise(F.col("resolution"))
    return views.edge_counts(resolved(spark, d).withColumn("resolution", graph_too))


@query("package_root", """, f AS (SELECT fqn, false AS more FROM symbols UNION ALL SELECT replace(fqn, 'geo.', 'com.acme.'), true FROM symbols), p AS (SELECT DISTINCT more, """ + PACKAGE.format("split_part(fqn, '#', 1)") + """ AS pkg FROM f),
o AS (SELECT more, regexp_extract(pkg, '^[^.]*\\.[^.]*') AS root, count(*) AS n FROM p WHERE contains(pkg, '.') GROUP BY 1, 2)
SELECT o.more, o.root FROM o JOIN (SELECT more, sum(n) AS total FROM o GROUP BY 1) USING (more) WHERE 2 * n > total""")
def package_root(spark, d):
    """The owner of the symbols as they are (none has more than half of the packages), and with a part of them below one owner."""
    s = derive.symbols(spark, d).select("fqn")
    moved = s.select(F.replace("fqn", F.lit("geo."), F.lit("com.acme.")).alias("fqn"))
    of = lambda x, more: resolve.package_root(resolve.packages_of(x)).select(F.lit(more).alias("more"), "root")
    return of(s, False).unionByName(of(moved, True))


# ---- names


@query("name_functions", """SELECT fqn, split_part(fqn, '(', 1) AS prefix, """ + SIMPLE.format("fqn") + """ AS simple, CASE WHEN contains(fqn, '#') THEN split_part(regexp_replace(fqn, '^[^#]*#', ''), '(', 1) END AS member,
 regexp_replace(regexp_replace(lower(fqn), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, ceil(strlen(fqn) / 3.5)::BIGINT AS tokens, substr(sha256(fqn), 1, 32) AS hash FROM symbols""")
def name_functions(spark, d):
    f = F.col("fqn")
    return derive.symbols(spark, d).select("fqn", N.prefix_of(f).alias("prefix"), N.simple_key(f).alias("simple"), N.member_name(f).alias("member"), N.slug(f).alias("slug"), N.estimate_tokens(f).alias("tokens"), N.content_hash(f).alias("hash"))


@query("subject_prefixes", ", p AS (SELECT fqn, regexp_extract_all(fqn, '[:.#/(]*[^:.#/(]+') AS x FROM symbols) SELECT fqn, unnest(list_transform(range(1, len(x) + 1), lambda i: array_to_string(x[1:i], ''))) AS subject FROM p")
def subject_prefixes(spark, d):
    return derive.symbols(spark, d).select("fqn", F.explode(N.subject_prefixes(F.col("fqn"))).alias("subject"))


@query("facts_for_seeds", """, facts AS (SELECT 'arch.' || p_partkey AS fact_key, CASE p_size % 3 WHEN 0 THEN 'catalog.' || p_brand WHEN 1 THEN 'catalog' ELSE 'catalog.' || p_brand || '#part_' || p_partkey END AS subject FROM part),
sd AS (SELECT unnest(['catalog.Brand#12#part_1(3)', 'catalog.Brand#11']) AS seed), anc AS (SELECT seed, unnest(list_transform(range(1, len(x) + 1), lambda i: array_to_string(x[1:i], ''))) AS subject FROM (SELECT seed, regexp_extract_all(seed, '[:.#/(]*[^:.#/(]+') AS x FROM sd))
SELECT seed, fact_key FROM anc JOIN facts USING (subject) UNION SELECT seed, fact_key FROM sd JOIN facts ON starts_with(subject, seed)""")
def facts_for_seeds(spark, d):
    p = read(spark, d, "part")
    brand = F.concat(F.lit("catalog."), "p_brand")
    subject = F.when(F.col("p_size") % 3 == 0, brand).when(F.col("p_size") % 3 == 1, F.lit("catalog")).otherwise(F.concat(brand, F.lit("#part_"), F.col("p_partkey").cast("string")))
    facts = p.select(F.concat(F.lit("arch."), F.col("p_partkey").cast("string")).alias("fact_key"), subject.alias("subject"))
    return states.facts_for_seeds(facts, seeds(spark, "catalog.Brand#12#part_1(3)", "catalog.Brand#11"))


# ---- text ranking


BM25 = """, q0 AS (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark WHERE item_id % 50 = 0), q AS (SELECT query_id, term, count(*) AS times FROM q0 GROUP BY 1, 2),
d0 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM documents), st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM d0), ex AS (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM d0),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, doc_id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2)
SELECT query_id, doc_id, floor(score * 1e4 + 0.5) / 1e4 AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score * 1e4 + 0.5) DESC, doc_id) AS r FROM s) WHERE r <= 10"""


@query("bm25_top10", BM25)
def bm25_top10(spark, d):
    queries = read(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    s = ranking.bm25(read(spark, d, "documents"), queries).withColumn("score", F.floor(F.col("score") * 1e4 + 0.5) / 1e4)
    return ranking.top(s, "query_id", [F.desc("score"), F.col("doc_id")], 10).select("query_id", "doc_id", "score")


@query("churn", NO_CTE + "WITH n AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT user_id, floor(ln(n + 1) / ln((SELECT max(n) FROM n) + 1) * 1e6 + 0.5) / 1e6 AS churn FROM n")
def churn(spark, d):
    return ranking.churn(read(spark, d, "events"), "user_id").select("user_id", micro(F.col("churn"), "churn"))


@query("query_overlap", NO_CTE + """WITH d AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))) AS term FROM documents), df AS (SELECT term, count(*) AS df FROM d GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS term FROM benchmark)
SELECT b.item_id AS query_id, count(df.term) AS overlap FROM benchmark b LEFT JOIN q ON q.query_id = b.item_id AND octet_length(encode(q.term)) >= 4 AND q.term NOT IN (""" + ", ".join(f"'{w}'" for w in STOPWORDS) + """) LEFT JOIN df ON df.term = q.term AND df.df < ceil((SELECT count(*) FROM documents) / 2) GROUP BY 1""")
def query_overlap(spark, d):
    """Of each benchmark item, the telling words that fewer than half of the documents have."""
    return ranking.query_overlap(read(spark, d, "documents"), read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


NINE = {"seed": "o_orderkey % 2", "graph": "o_orderkey % 10 / 10", "churn": "o_orderkey % 7 / 7", "recency": "o_orderkey % 3 / 3", "history": "o_custkey % 4 / 4", "fact": "o_custkey % 5 / 5", "test": "o_custkey % 2", "arch": "o_orderkey % 9 / 9"}


@query("rank_score", NO_CTE + "SELECT o_orderkey AS item, floor((" + " + ".join(f"{ranking.RANK[k]}::DOUBLE * ({v}::DOUBLE)" for k, v in NINE.items()) + " - 0.4 * least(greatest(o_totalprice / 400000, 0), 1)) * 1e4 + 0.5) / 1e4 AS score FROM orders".replace("o_totalprice", "o_totalprice::DOUBLE"))
def rank_score(spark, d):
    """All nine terms of a candidate's score."""
    s = ranking.score(cost=F.col("o_totalprice") / 400000, **{k: F.expr(v).cast("double") for k, v in NINE.items()})
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("item"), (F.floor(s * 1e4 + 0.5) / 1e4).alias("score"))


ANCHORED = "CASE WHEN seed = subject THEN 1.0 WHEN (starts_with(seed, subject) AND seed[length(subject) + 1] IN (':', '.', '#', '/', '(')) OR (starts_with(subject, seed) AND subject[length(seed) + 1] IN (':', '.', '#', '/', '(')) THEN 0.6 ELSE 0 END"


@query("fact_relevance", NO_CTE + """WITH f AS (SELECT p_partkey, p_size, CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN 'catalog.' || p_brand WHEN 2 THEN 'catalog.' || p_brand[1:4] WHEN 3 THEN 'catalog.Brand#11#part_1' ELSE 'catalog' END AS subject FROM part),
sd(seed) AS (VALUES ('catalog.Brand#11#part_1(3)'), ('catalog.Brand#12'), ('sales')), m AS (SELECT p_partkey, greatest(0.3, max(""" + ANCHORED + """)) AS m FROM f, sd GROUP BY 1)
SELECT p_partkey, floor(m::DOUBLE * (CASE p_size % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 ELSE 0.7 END) * (CASE p_size % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.85 ELSE 0.6 END) * greatest(least(exp(-p_size / 40.0), 1.0), 0.05) * 0.9 * 1e6 + 0.5) / 1e6 AS relevance FROM f JOIN m USING (p_partkey)""")
def fact_relevance(spark, d):
    """Parts as facts about a brand, the beginning of its name, one part, the catalog or nothing, for a request that starts at three names."""
    z = F.col("p_size")
    source = F.when(z % 3 == 0, "human").when(z % 3 == 1, "deterministic").otherwise("model")
    state = F.when(z % 5 == 0, "durable").when(z % 5 == 1, "validated").otherwise("candidate")
    subject = F.when(z % 5 == 1, F.concat(F.lit("catalog."), "p_brand")).when(z % 5 == 2, F.concat(F.lit("catalog."), F.left("p_brand", F.lit(4)))).when(z % 5 == 3, "catalog.Brand#11#part_1").when(z % 5 == 4, "catalog")
    match = ranking.subject_match(subject, F.array(*map(F.lit, ("catalog.Brand#11#part_1(3)", "catalog.Brand#12", "sales"))))
    return read(spark, d, "part").select("p_partkey", micro(ranking.relevance(match, source, state, z, F.lit(0.9)), "relevance"))


@query("budget_fill", NO_CTE + """WITH RECURSIVE c AS (SELECT o_custkey AS request_id, o_orderkey::VARCHAR AS item, (o_orderkey % 97) / 97.0 AS score, (o_orderkey % 50 + 1)::BIGINT AS tokens, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus ELSE '' END AS component, o_orderkey AS position, o_orderkey % 11 > 0 AS anchored FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score / tokens DESC, position) AS i FROM c),
f(request_id, i, used, taken, item, reason) AS (SELECT DISTINCT request_id, 0::BIGINT, 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR FROM n
 UNION ALL SELECT request_id, i, used + CASE WHEN reason = 'selected' THEN tokens ELSE 0 END, CASE WHEN reason = 'selected' THEN list_append(taken, component) ELSE taken END, item, reason FROM
 (SELECT n.request_id, n.i, f.used, f.taken, n.tokens, n.component, n.item, CASE WHEN NOT n.anchored THEN 'no file:line anchor' WHEN n.score < {least} THEN 'below floor ({least:.2f})' WHEN n.component <> '' AND len(list_filter(f.taken, lambda x: x = n.component)) >= {per} THEN 'at most {per} items from ' || n.component WHEN f.used + n.tokens > 100 THEN 'budget exhausted at 100 tokens' ELSE 'selected' END AS reason
 FROM f JOIN n ON n.request_id = f.request_id AND n.i = f.i + 1))
SELECT request_id, item, reason = 'selected' AS included, reason FROM f WHERE i > 0""".replace("{least:.2f}", f"{ranking.LEAST:.2f}").replace("{least}", str(ranking.LEAST)).replace("{per}", str(ranking.PER_COMPONENT)))
def budget_fill(spark, d):
    """Orders as candidates of their customers' requests; some have no anchor, some no component."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    component = F.when(k % 4 > 0, F.col("o_orderstatus")).otherwise("")
    c = o.select(F.col("o_custkey").alias("request_id"), k.cast("string").alias("item"), ((k % 97) / 97).alias("score"), (k % 50 + 1).alias("tokens"), component.alias("component"), k.alias("position"), F.when(k % 11 > 0, "f:1").alias("anchor"))
    return ranking.filled(c, 100)


# ---- snapshots, findings, facts

SNAP = """, old AS (SELECT source || '/' || doc_id AS fqn, CASE WHEN doc_id % 11 > 0 THEN md5(lang) END AS sig_hash, md5(text) AS body_hash, [lang, 'x'] AS ann FROM documents WHERE doc_id % 5 <> 0),
new AS (SELECT source || '/' || doc_id AS fqn, CASE WHEN doc_id % 11 > 0 THEN md5(CASE WHEN doc_id % 7 = 0 THEN lang || '!' ELSE lang END) END AS sig_hash, md5(CASE WHEN doc_id % 3 = 0 THEN text || ' ' ELSE text END) AS body_hash, CASE WHEN doc_id % 13 = 0 THEN ['x'] ELSE ['x', lang] END AS ann FROM documents WHERE doc_id % 5 = 0 OR doc_id % 4 <> 0)
"""


@query("symbol_diff", SNAP + """SELECT change, count(*) AS n FROM (SELECT CASE WHEN o.fqn IS NULL THEN 'added' WHEN n.fqn IS NULL THEN 'removed' WHEN o.sig_hash IS DISTINCT FROM n.sig_hash AND o.body_hash IS DISTINCT FROM n.body_hash THEN 'api_and_body' WHEN o.sig_hash IS DISTINCT FROM n.sig_hash THEN 'api' WHEN list_sort(o.ann) IS DISTINCT FROM list_sort(n.ann) THEN 'contract' WHEN o.body_hash IS DISTINCT FROM n.body_hash THEN 'body' END AS change FROM old o FULL JOIN new n ON o.fqn = n.fqn) WHERE change IS NOT NULL GROUP BY change""")
def symbol_diff(spark, d):
    """Every document is in at least one of the two snapshots; some have no signature, some lose an annotation."""
    t = read(spark, d, "documents").withColumn("fqn", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")))
    i = F.col("doc_id")
    sig = lambda c: F.when(i % 11 > 0, F.md5(c)).alias("sig_hash")
    old = t.where(i % 5 != 0).select("fqn", sig(F.col("lang")), F.md5("text").alias("body_hash"), F.array("lang", F.lit("x")).alias("annotations"))
    ann = F.when(i % 13 == 0, F.array(F.lit("x"))).otherwise(F.array(F.lit("x"), "lang")).alias("annotations")
    new = t.where((i % 5 == 0) | (i % 4 != 0)).select("fqn", sig(F.when(i % 7 == 0, F.concat("lang", F.lit("!"))).otherwise(F.col("lang"))), F.md5(F.when(i % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))).alias("body_hash"), ann)
    return incremental.symbol_diff(old, new).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query("file_renames", NO_CTE + """WITH a AS (SELECT source || '/' || doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source || '/' || doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 2 = 1)
SELECT a.path AS old_path, b.p AS new_path FROM (SELECT min(path) AS path, h FROM a GROUP BY h HAVING count(*) = 1) a JOIN (SELECT h, max(path) AS p FROM b GROUP BY h) b USING (h)""")
def file_renames(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.md5("text").alias("content_hash"))
    return incremental.file_renames(t.where("doc_id % 2 = 0").drop("doc_id"), t.where("doc_id % 2 = 1").drop("doc_id"))


@query("symbol_renames", NO_CTE + """WITH a AS (SELECT lang AS name, source AS fqn, md5(text) AS b FROM documents WHERE doc_id % 2 = 0), c AS (SELECT lang AS name, source || '!' AS fqn, md5(text) AS b FROM documents WHERE doc_id % 2 = 1)
SELECT x.fqn AS old_fqn, y.fqn AS new_fqn FROM (SELECT name, b, min(fqn) AS fqn FROM a GROUP BY 1, 2 HAVING count(*) = 1) x JOIN (SELECT name, b, min(fqn) AS fqn FROM c GROUP BY 1, 2 HAVING count(*) = 1) y USING (name, b)""")
def symbol_renames(spark, d):
    t = read(spark, d, "documents").select("doc_id", F.col("lang").alias("name"), F.col("source").alias("fqn"), F.lit("s").alias("sig_hash"), F.md5("text").alias("body_hash"))
    return incremental.renames(t.where("doc_id % 2 = 0").drop("doc_id"), t.where("doc_id % 2 = 1").drop("doc_id").withColumn("fqn", F.concat("fqn", F.lit("!"))))


@query("upsert", NO_CTE + "SELECT coalesce(b.k, a.k) AS k, CASE WHEN b.k IS NOT NULL THEN b.v ELSE a.v END AS v, CASE WHEN b.k IS NOT NULL THEN false ELSE a.deleted END AS deleted FROM (SELECT c_custkey AS k, c_acctbal AS v, c_custkey % 3 = 0 AS deleted FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 > 0 THEN c_acctbal + 1 END AS v FROM customer WHERE c_custkey % 2 = 1 OR c_custkey % 5 = 0) b ON a.k = b.k")
def upsert(spark, d):
    """Every customer is stored or comes in; some come in without a value."""
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    stored = c.where(k % 2 == 0).select(k.alias("k"), F.col("c_acctbal").alias("v"), (k % 3 == 0).alias("deleted"))
    incoming = c.where((k % 2 == 1) | (k % 5 == 0)).select(k.alias("k"), F.when(k % 7 > 0, F.col("c_acctbal") + 1).alias("v"), F.lit(False).alias("deleted"))
    return incremental.upsert(stored, incoming, "k")


@query("replace_symbols", NO_CTE + """WITH o AS (SELECT min(p_partkey) AS k, p_brand AS fqn FROM part WHERE p_partkey % 3 > 0 GROUP BY 2), stored AS (SELECT o.fqn, p_type AS file_path, CASE WHEN p_size % 4 = 0 THEN 'declares' ELSE 'implements' END AS authority, p_size % 9 = 0 AS deleted FROM o JOIN part ON p_partkey = k),
incoming AS (SELECT DISTINCT p_brand AS fqn, p_type AS file_path, CASE WHEN p_size % 5 = 0 THEN 'declares' ELSE 'implements' END AS authority FROM part WHERE p_partkey % 3 = 0 AND p_size % 6 = 1), files AS (SELECT DISTINCT p_type AS path FROM part WHERE p_partkey % 7 = 0 OR p_size % 6 = 1),
x AS (SELECT *, NOT deleted AND file_path NOT IN (SELECT path FROM files) AS holds, 0 AS new FROM stored UNION ALL SELECT *, false, true, 1 FROM incoming),
w AS (SELECT *, row_number() OVER (PARTITION BY fqn ORDER BY holds DESC, authority = 'declares' DESC, new DESC, file_path DESC) AS r, max(holds::INT) OVER (PARTITION BY fqn) AS any_holds FROM x)
SELECT fqn, file_path, authority, CASE WHEN new = 1 THEN false ELSE deleted OR NOT holds END AS deleted FROM w WHERE r = 1""")
def replace_symbols(spark, d):
    """Brands as names, types as files; some files come in again, with other names or none."""
    p = read(spark, d, "part")
    row = lambda k: [F.col("p_brand").alias("fqn"), F.col("p_type").alias("file_path"), F.when(F.col("p_size") % k == 0, "declares").otherwise("implements").alias("authority")]
    first = p.where("p_partkey % 3 > 0").groupBy("p_brand").agg(F.min("p_partkey").alias("p_partkey"))
    stored = p.join(first, ["p_brand", "p_partkey"]).select(*row(4), (F.col("p_size") % 9 == 0).alias("deleted"))
    incoming = p.where("p_partkey % 3 = 0 AND p_size % 6 = 1").select(*row(5), F.lit(False).alias("deleted")).distinct()
    files = p.where("p_partkey % 7 = 0 OR p_size % 6 = 1").select(F.col("p_type").alias("path"))
    return incremental.replace_symbols(stored, incoming, files)


@query("finding_lifecycle", NO_CTE + """WITH b AS (SELECT min(ts)::DATE AS first, max(ts)::DATE AS last FROM events), g AS (SELECT u.user_id AS fingerprint, s.scan_id FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(1, (last - first) + 2)) AS scan_id FROM b) s),
p AS (SELECT DISTINCT user_id, (ts::DATE - first) + 1 AS scan_id FROM events, b WHERE event_type = 'error'),
x AS (SELECT g.fingerprint, g.scan_id, p.user_id IS NOT NULL AS present FROM g LEFT JOIN p ON p.user_id = g.fingerprint AND p.scan_id = g.scan_id),
w AS (SELECT *, lag(present) OVER (PARTITION BY fingerprint ORDER BY scan_id) AS before, coalesce(max(present::INT) OVER (PARTITION BY fingerprint ORDER BY scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS ever FROM x)
SELECT fingerprint, scan_id::INT AS scan_id, CASE WHEN present AND NOT ever THEN 'NEW' WHEN present AND before THEN 'RECURRING' WHEN present THEN 'REGRESSED' WHEN before THEN 'FIXED' ELSE 'ABSENT' END AS status FROM w WHERE present OR ever""")
def finding_lifecycle(spark, d):
    """Users as findings; a scan a day, from the first day of the events to the last."""
    e = read(spark, d, "events").withColumn("day", F.to_date("ts"))
    ends = F.broadcast(e.agg(F.min("day").alias("first"), F.max("day").alias("last")))
    hit = e.where("event_type = 'error'").crossJoin(ends)
    return incremental.lifecycle_of(hit.select(F.col("user_id").alias("fingerprint"), (F.datediff("day", "first") + 1).alias("scan_id"), (F.datediff("last", "first") + 1).alias("scans")))


@query("fact_versions", NO_CTE + "SELECT p_brand || p_type AS fact_key, p_partkey AS scan_id, p_name AS claim, lead(p_partkey) OVER w AS superseded_by, lead(p_partkey) OVER w IS NULL AS live FROM part WINDOW w AS (PARTITION BY p_brand || p_type ORDER BY p_partkey)")
def fact_versions(spark, d):
    return incremental.fact_versions(read(spark, d, "part").select(F.concat("p_brand", "p_type").alias("fact_key"), F.col("p_partkey").alias("scan_id"), F.col("p_name").alias("claim")))


@query("fact_durable", NO_CTE + "WITH v AS (SELECT DISTINCT user_id AS fact_key, day(ts)::INT AS scan_id FROM events WHERE event_type = 'view') SELECT fact_key, scan_id, count(*) OVER w AS survived, count(*) OVER w >= 3 AS durable FROM v WINDOW w AS (PARTITION BY fact_key ORDER BY scan_id ROWS UNBOUNDED PRECEDING)")
def fact_durable(spark, d):
    return incremental.durable(read(spark, d, "events").where("event_type = 'view'").select(F.col("user_id").alias("fact_key"), F.dayofmonth("ts").alias("scan_id")))


@query("latest_occurrence", NO_CTE + "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_occurrence(spark, d):
    return ranking.top(read(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 1).select("user_id", "event_id", "event_type")


@query("findings_order", NO_CTE + "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS rank FROM orders ORDER BY rank, o_totalprice DESC, o_orderkey LIMIT 100")
def findings_order(spark, d):
    rank = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    return read(spark, d, "orders").withColumn("rank", rank).orderBy("rank", F.desc("o_totalprice"), "o_orderkey").limit(100).select("o_orderkey", "rank")


@query("worst_finding", NO_CTE + "SELECT o_custkey AS component, max(CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.8 WHEN 'P' THEN 0.5 ELSE 0 END)::DOUBLE AS worst FROM orders GROUP BY 1")
def worst_finding(spark, d):
    w = F.when(F.col("o_orderstatus") == "F", 1.0).when(F.col("o_orderstatus") == "O", 0.8).when(F.col("o_orderstatus") == "P", 0.5).otherwise(0.0)
    return read(spark, d, "orders").groupBy(F.col("o_custkey").alias("component")).agg(F.max(w).alias("worst"))


@query("calibration_error", NO_CTE + """WITH j AS (SELECT lang AS tier, (n_chars % 4) / 5.0 AS c, quality::DOUBLE AS y FROM labels JOIN documents USING (doc_id)), b AS (SELECT tier, c, count(*) AS n, avg(y) AS y FROM j GROUP BY 1, 2)
SELECT (SELECT floor(avg((c - y) * (c - y)) * 1e6 + 0.5) / 1e6 FROM j) AS brier, floor(sum(n * abs(c - y)) / sum(n) * 1e6 + 0.5) / 1e6 AS ece FROM b""")
def calibration_error(spark, d):
    """Labels as outcomes, languages as tiers, and four claims."""
    j = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars", F.col("lang").alias("tier")), "doc_id")
    e = evaluation.brier_ece(j.select("tier", ((F.col("n_chars") % 4) / 5.0).alias("confidence"), F.col("quality").alias("correct")))
    return e.select(micro(F.col("brier"), "brier"), micro(F.col("ece"), "ece"))


@query("working_tree_hash", NO_CTE + """WITH l AS (SELECT source, md5(source || '/' || doc_id)[1:4] AS leaf, source || '/' || doc_id || chr(9) || md5(text) AS line FROM documents),
f AS (SELECT source, leaf, sha256(string_agg(line, chr(10) ORDER BY line)) AS h FROM l GROUP BY 1, 2) SELECT source, sha256(string_agg(leaf || h, chr(10) ORDER BY leaf)) AS digest FROM f GROUP BY 1""")
def working_tree_hash(spark, d):
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return incremental.tree_hash(read(spark, d, "documents").select("source", path.alias("path"), F.md5("text").alias("content_hash")), "source")


@query("language_shares", NO_CTE + "SELECT lang, count(*) AS n, floor(count(*) * 1e6 / (SELECT count(*) FROM documents) + 0.5) / 1e6 AS share FROM documents GROUP BY lang")
def language_shares(spark, d):
    g = read(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("total", F.sum("n").over(Window.partitionBy())).select("lang", "n", micro(F.col("n") / F.col("total"), "share"))


@query("deleted_files", NO_CTE + "SELECT doc_id FROM documents WHERE doc_id % 2 = 0 EXCEPT SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def deleted_files(spark, d):
    t = read(spark, d, "documents").select("doc_id")
    return t.where("doc_id % 2 = 0").join(t.where("doc_id % 3 = 0"), "doc_id", "left_anti")


@query("attempt_numbers", NO_CTE + "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS attempt FROM events")
def attempt_numbers(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", F.row_number().over(w).cast("long").alias("attempt"))


@query("dedup_in_order", NO_CTE + "SELECT user_id, event_type, min(event_id) AS position FROM events GROUP BY 1, 2")
def dedup_in_order(spark, d):
    return read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("position"))


@query("edge_dump", "SELECT src, dst, edge_type, confidence FROM edges")
def edge_dump(spark, d):
    return derive.edges(spark, d).select("src", "dst", "edge_type", "confidence")


from . import context, found, kept, measures, reviews, search  # noqa: E402, F401  register their queries here


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact_reverse(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
