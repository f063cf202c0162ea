"""Registered queries of edges judged by an oracle and of paired benchmark runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import benchmarks, matching
from ..operators.settle import FEW_NUMBERS, sized
from . import derive
from .catalog import NO_CTE, query
from .derive import read

SITES = """, sp AS (SELECT fqn, file_path, start_line, start_line + CASE WHEN kind = 'method' THEN 3 + start_line % 20 ELSE 400 END AS end_line FROM symbols),
e AS (SELECT a.file_path AS src_file, a.start_line + e.site_line AS site_line, e.edge_type, CASE e.site_line WHEN 3 THEN 'external' ELSE 'exact' END AS tier, CASE WHEN a.start_line % 9 > 0 THEN b.file_path END AS dst_file, b.start_line AS dst_start, b.end_line AS dst_end FROM edges e JOIN sp a ON a.fqn = e.src JOIN sp b ON b.fqn = e.dst),
refs AS (SELECT a.file_path AS file, a.start_line + e.site_line AS line, e.dst AS symbol FROM edges e JOIN sp a ON a.fqn = e.src WHERE a.start_line % 7 > 0), defs AS (SELECT fqn AS symbol, file_path AS file, start_line + 1 AS line FROM sp WHERE start_line % 5 > 0),
tr AS (SELECT DISTINCT r.file AS src_file, r.line AS site_line, d.file AS df, d.line AS dl FROM refs r JOIN defs d USING (symbol)),
can AS (SELECT *, edge_type IN ('calls', 'implements', 'extends', 'imports') AND tier <> 'external' AS can FROM e),
w AS (SELECT src_file, site_line, dst_file, dst_start, dst_end, min(dst_end - dst_start) AS width FROM (SELECT DISTINCT src_file, site_line, dst_file, dst_start, dst_end FROM can WHERE can) c JOIN tr USING (src_file, site_line) WHERE df = dst_file AND dl BETWEEN dst_start AND dst_end GROUP BY ALL),
b AS (SELECT src_file, site_line, min(width) AS best FROM w GROUP BY 1, 2), t AS (SELECT DISTINCT src_file, site_line FROM tr),
v AS (SELECT can.*, CASE WHEN NOT can THEN 'blind' WHEN t.src_file IS NULL THEN 'silent' WHEN width = best THEN 'right' ELSE 'wrong' END AS verdict FROM can LEFT JOIN w USING (src_file, site_line, dst_file, dst_start, dst_end) LEFT JOIN b USING (src_file, site_line) LEFT JOIN t USING (src_file, site_line))
"""


TYPES = ("calls", "extends", "implements", "injects")


def placed(spark, d):
    """Edges with the places of both ends: ``src_file, site_line, dst_file, dst_start, code``, dealt by site; ``code`` is what ``coded`` packs.

    Rows go by the keys that names are made of, and a name's file and line follow from its own row, so no names are exchanged; files are
    numbers, if no two of those that can be have one. Names that are null drop out; ends that are there several times make as many rows, as where edges, which
    are distinct, are joined by name.
    """
    m = derive.members(spark, d)
    n = derive.nations(spark, d).withColumn("k", F.col("n_nationkey").cast("long"))
    o = read(spark, d, "orders").where("o_orderkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_orderstatus IS NOT NULL")
    o = o.select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"), "o_orderstatus")
    parent = F.concat(F.lit("sales.y"), F.col("y").cast("string")).alias("parent")
    folders = n.select(F.col("region_fqn").alias("x")).union(n.select("nation_fqn")).union(m["part"].select("nation_fqn")).union(o.select(parent)).where("x IS NOT NULL").distinct()
    files = folders.select(F.explode(F.array(*[derive.file_of(F.col("x"), F.lit(i)) for i in (3, 7, 1)])).alias("f")).distinct()
    one_each = files.agg(F.count(F.lit(1)) == F.count_distinct(F.xxhash64("f"))).first()[0]
    number = F.xxhash64 if one_each else (lambda c: c)
    file = lambda parent, k, end: number(derive.file_of(F.col(parent), F.col(k))).alias(f"{end}_file")
    target = lambda parent, k: [file(parent, k, "dst"), derive.line_of(F.col(k)).alias("dst_start")]

    def source(parent, k, line, edge_type, method):
        start = derive.line_of(F.col(k))
        return [file(parent, k, "src"), (start + line).alias("site_line"), coded(start, line, edge_type, method)]

    there = lambda df: df.where("fqn IS NOT NULL").select("k", "nation_fqn")
    none = F.lit(0)
    regions = F.broadcast(n.select(F.col("region_fqn").alias("up")).distinct().withColumn("zero", F.lit(0)).select("up", *target("up", "zero")))
    classes = F.broadcast(n.select(F.col("nation_fqn").alias("up"), *target("region_fqn", "k")))
    above = F.broadcast(n.select(F.col("nation_fqn").alias("name"), F.col("region_fqn").alias("up")).distinct())
    parts = [n.select("nation_fqn", *source("region_fqn", "k", none, "extends", False)).join(above, F.col("nation_fqn") == F.col("name")).join(regions, "up")]
    for who, kind in (("customer", "extends"), ("supplier", "implements")):
        parts.append(there(m[who]).select("nation_fqn", *source("nation_fqn", "k", none, kind, False)).join(classes, F.col("nation_fqn") == F.col("up")))
    # a name that several orders have goes to each of their customers as often as there are orders
    o, name = o.repartition("o_orderkey"), ["o_orderkey", "y", "o_orderstatus"]
    calls = o.groupBy(*name, "o_custkey").agg(F.count(F.lit(1)).alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy(*name))).where("o_custkey IS NOT NULL")
    calls = calls.select("o_custkey", "o_orderkey", parent, F.explode(F.array_repeat(none, F.col("n").cast("int")))).select("o_custkey", *source("parent", "o_orderkey", none, "calls", True))
    parts.append(calls.join(there(m["customer"]), F.col("o_custkey") == F.col("k")).select("*", *target("nation_fqn", "k")))
    rows, keys = o.select("o_orderkey", parent), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"]
    lines = read(spark, d, "lineitem").select(*keys).where("l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL").repartition("l_orderkey").dropDuplicates(keys)
    # up to a million suppliers are sent to the lines as two numbers each; their nations follow there
    suppliers, _ = sized(read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey").where("k IS NOT NULL"), FEW_NUMBERS)
    for key, off, kind, method in (("l_partkey", "l_discount", "calls", True), ("l_suppkey", "l_tax", "injects", False)):
        some = lines.where(F.col(key).isNotNull()).withColumn("confidence", 1 - F.col(off)).dropDuplicates(["l_orderkey", "l_linenumber", key, "confidence"])
        some = some.join(rows, F.col("l_orderkey") == F.col("o_orderkey")).select(key, *source("parent", "l_orderkey", F.col("l_linenumber"), kind, method))
        if method:
            some = some.join(there(m["part"]), F.col(key) == F.col("k"))
        else:
            some = some.join(suppliers, F.col(key) == F.col("k")).join(F.broadcast(n.select("n_nationkey", "nation_fqn")), F.col("s_nationkey") == F.col("n_nationkey")).where("nation_fqn IS NOT NULL")
        parts.append(some.select("*", *target("nation_fqn", "k")))
    columns = ["src_file", "site_line", "dst_file", "dst_start", "code"]
    out = parts[0].select(*columns)
    for x in parts[1:]:
        out = out.unionByName(x.select(*columns))
    return out.repartition("src_file", "site_line")


def coded(start, line, edge_type, method):
    """What is known of an edge before its target: its type, whether it is resolved outside, has a target, and is among the oracle's references, and whether that is a method."""
    bits = (line == 3, start % 9 > 0, start % 7 > 0, F.lit(method))
    return sum((b.cast("int") * 2 ** (i + 2) for i, b in enumerate(bits)), F.lit(TYPES.index(edge_type))).alias("code")


def bit(i):
    return F.col("code").bitwiseAND(2 ** (i + 2)) > 0


def edge_type():
    return F.element_at(F.array(*map(F.lit, TYPES)), F.col("code").bitwiseAND(3) + 1).alias("edge_type")


def tier():
    return F.when(bit(0), "external").otherwise("exact").alias("tier")


def judged(spark, d):
    """Edges with spans, and an oracle of what they refer to that knows most sites and most definitions: ``src_file, site_line, code, verdict``."""
    z = F.col("dst_start")
    rows = placed(spark, d).withColumns({"edge_type": edge_type(), "tier": tier()}).withColumn("can", matching.judgeable())
    # an edge without a target keeps its file, in which the oracle may know a line, and has no span
    start, last = F.when(bit(1), z), z + F.when(bit(3), 3 + z % 20).otherwise(400)
    return matching.met(rows.select("src_file", "site_line", "dst_file", "code", "can", start.alias("dst_start"), last.alias("dst_end"), (z + 1).alias("known_line"), F.lit(True).alias("edge"), (bit(2) & (z % 5 > 0)).alias("known")))


@query("oracle_verdicts", SITES + "SELECT edge_type, tier, verdict, count(*) AS n FROM v GROUP BY ALL")
def oracle_verdicts(spark, d):
    n = judged(spark, d).groupBy("code", "verdict").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(edge_type(), tier(), "verdict").agg(F.sum("n").alias("n"))


@query("oracle_comparison", SITES + "SELECT count(DISTINCT (src_file, site_line)) AS sites, count_if(verdict IN ('right', 'wrong'))::BIGINT AS judged, count_if(verdict = 'right')::BIGINT AS correct, count_if(verdict = 'silent')::BIGINT AS silent, count_if(verdict = 'blind')::BIGINT AS blind FROM v")
def oracle_comparison(spark, d):
    return matching.comparison(judged(spark, d))


@query("oracle_coverage", """, f AS (SELECT DISTINCT file_path AS path, regexp_extract(file_path, '\\.([^./]+)$', 1) AS e FROM symbols), o AS (SELECT DISTINCT file_path AS path, regexp_extract(file_path, '\\.([^./]+)$', 1) AS e FROM symbols WHERE kind = 'method' AND start_line % 50 = 1 AND file_path LIKE '%.java'),
c AS (SELECT count(*) AS comparable, count(o.path) AS seen FROM f LEFT JOIN o USING (path) WHERE f.e IN (SELECT e FROM o)) SELECT comparable, seen, round(CASE WHEN comparable > 0 THEN seen / comparable ELSE 0 END, 6) AS coverage, CASE WHEN comparable > 0 THEN seen / comparable ELSE 0 END < 0.95 AS partial FROM c""")
def oracle_coverage(spark, d):
    s = derive.symbols(spark, d)
    seen = s.where("kind = 'method' AND start_line % 50 = 1 AND file_path LIKE '%.java'")
    return matching.file_coverage(s.select(F.col("file_path").alias("path")), seen.select(F.col("file_path").alias("path"))).withColumn("coverage", F.round("coverage", 6))


RUNS = "WITH runs AS (SELECT 'A' || (o_custkey % 3) AS arm, o_custkey % 25 AS task, floor(o_totalprice / 10)::BIGINT AS tokens, o_orderkey % 3 = 0 AS passed, o_orderkey % 7 = 0 AS flagged, o_orderkey % 11 = 0 AS infra FROM orders)"


def runs(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return read(spark, d, "orders").select(F.concat(F.lit("A"), (c % 3).cast("string")).alias("arm"), (c % 25).alias("task"), F.floor(F.col("o_totalprice") / 10).alias("tokens"), (k % 3 == 0).alias("passed"), (k % 7 == 0).alias("flagged"), (k % 11 == 0).alias("infra"))


@query("benchmark_arms", NO_CTE + RUNS + """, ran AS (SELECT * FROM runs WHERE NOT infra), k AS (SELECT arm, tokens, row_number() OVER (PARTITION BY arm ORDER BY tokens) AS r, count(*) OVER (PARTITION BY arm) AS n FROM ran),
h AS (SELECT arm, median(tokens)::DOUBLE AS median, median(tokens) FILTER (r <= n // 2)::DOUBLE AS low, median(tokens) FILTER (r > (n + 1) // 2)::DOUBLE AS high FROM k GROUP BY arm),
s AS (SELECT arm, count(*) AS n_total, count_if(infra)::BIGINT AS n_infra, count_if(flagged AND NOT infra)::BIGINT AS n_flagged, count_if(NOT flagged AND NOT infra)::BIGINT AS n_clean, count(DISTINCT task) AS n_tasks, count_if(passed AND NOT flagged AND NOT infra)::BIGINT AS passes, max(tokens) FILTER (NOT infra) AS max_tokens, sum(tokens) FILTER (NOT infra) AS spent, sum(tokens) FILTER (NOT infra AND NOT flagged) AS clean FROM runs GROUP BY arm)
SELECT arm, n_total, n_infra, n_flagged, n_clean, n_tasks, passes, max_tokens, median, low, high, round(passes / n_clean, 6) AS pass_rate, round(passes / (n_clean + n_flagged), 6) AS pass_rate_flagged_fail, round(spent / passes, 4) AS cps, round(clean / passes, 4) AS cps_clean FROM s JOIN h USING (arm)""")
def benchmark_arms(spark, d):
    """Orders as runs of three arms at 25 tasks."""
    r = lambda c, k: F.round(c, k).alias(c)
    return benchmarks.arm_stats(runs(spark, d)).select("arm", "n_total", "n_infra", "n_flagged", "n_clean", "n_tasks", "passes", "max_tokens", "median", "low", "high", r("pass_rate", 6), r("pass_rate_flagged_fail", 6), r("cps", 4), r("cps_clean", 4))


@query("benchmark_medians", NO_CTE + "SELECT o_orderpriority AS task, floor(median(o_totalprice) * 100 + 0.5) / 100 AS cost, count(*) AS n FROM orders GROUP BY 1")
def benchmark_medians(spark, d):
    h = benchmarks.hinges(read(spark, d, "orders"), "o_totalprice", "o_orderpriority")
    return h.select(F.col("o_orderpriority").alias("task"), (F.floor(F.col("median") * 100 + 0.5) / 100).alias("cost"), "n")


DELTAS = RUNS + """, m AS (SELECT task, median(tokens) FILTER (arm = 'A1') AS x, median(tokens) FILTER (arm = 'A2') AS y FROM runs WHERE NOT infra GROUP BY task), dl AS (SELECT task % 2 AS half, task, (x - y)::DOUBLE AS delta FROM m WHERE x IS NOT NULL AND y IS NOT NULL)"""


def deltas(spark, d):
    return benchmarks.paired_deltas(runs(spark, d), "A1", "A2").withColumn("half", F.col("task") % 2)


@query("paired_bootstrap", NO_CTE + DELTAS + """, k AS (SELECT half, delta, row_number() OVER (PARTITION BY half ORDER BY delta) - 1 AS place, count(*) OVER (PARTITION BY half) AS n FROM dl), z AS (SELECT DISTINCT half, n FROM k),
w AS (SELECT half, n, r, ('0x' || md5('20260904:' || half || ':' || r || ':' || j)[1:8])::BIGINT % n AS place FROM z, range(10000) t(r), LATERAL (SELECT unnest(range(n)) AS j)), q AS (SELECT w.half, w.n, r, median(delta) AS m FROM w JOIN k ON k.half = w.half AND k.place = w.place GROUP BY 1, 2, 3),
o AS (SELECT *, row_number() OVER (PARTITION BY half ORDER BY m, r) - 1 AS i FROM q) SELECT half, n::INT AS n, max(m) FILTER (i = 250) AS low, max(m) FILTER (i = 9750) AS high FROM o GROUP BY 1, 2""")
def paired_bootstrap(spark, d):
    """Intervals of the median difference of two arms, over even and odd tasks, from 10,000 resamples."""
    return benchmarks.paired_bootstrap(deltas(spark, d), "half")


@query("sign_test", NO_CTE + RUNS + """, g AS (SELECT task, arm, count_if(tokens < 15000)::BIGINT AS better, count(*) AS total FROM runs GROUP BY 1, 2)
SELECT task, arm, better, total, round(list_sum(list_transform(range(0, total - better + 1), lambda i: exp(lgamma(total + 1) - lgamma(i + 1) - lgamma(total - i + 1) - total * ln(2)))), 6) AS p FROM g""")
def sign_test(spark, d):
    """Runs of an arm at a task as pairs, better below 15,000 tokens; at a larger scale there are thousands of them."""
    delta = F.when(F.col("tokens") < 15000, -1.0).otherwise(1.0)
    return benchmarks.sign_test(runs(spark, d).select("task", "arm", delta.alias("delta")), "task", "arm").withColumn("p", F.round("p", 6))
