"""Views of the code model over the driver's tables: symbols, edges, hints, files, snapshots, findings, facts.

Each view is written twice on purpose: as DataFrames for the engine and as SQL for the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import WEIGHTS
from ..operators.settle import settled

def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nations(spark: SparkSession, d: str) -> DataFrame:
    r, n = read(spark, d, "region"), read(spark, d, "nation")
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat(F.lit("geo."), "r_name").alias("region_fqn"), F.concat(F.lit("geo."), "r_name", F.lit("."), "n_name").alias("nation_fqn"))


def order_fqn():
    return F.concat(F.lit("sales.y"), F.year("o_orderdate").cast("string"), F.lit("#order_"), F.col("o_orderkey").cast("string"), F.lit("("), "o_orderstatus", F.lit(")"))


def members(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Keys and names of the leaf symbols."""
    n = F.broadcast(nations(spark, d))
    c, s = read(spark, d, "customer"), read(spark, d, "supplier")
    return {
        "customer": c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("k"), "nation_fqn", F.concat("nation_fqn", F.lit("#customer_"), F.col("c_custkey").cast("string"), F.lit("("), "c_mktsegment", F.lit(")")).alias("fqn")),
        "supplier": s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_suppkey").alias("k"), "nation_fqn", F.concat("nation_fqn", F.lit("#supplier_"), F.col("s_suppkey").cast("string"), F.lit("()")).alias("fqn")),
        "part": read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("catalog."), "p_brand").alias("nation_fqn"), F.concat(F.lit("catalog."), "p_brand", F.lit("#part_"), F.col("p_partkey").cast("string"), F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("fqn")),
        "order": read(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("sales.y"), F.year("o_orderdate").cast("string")).alias("nation_fqn"), order_fqn().alias("fqn")),
    }


def file_of(parent, k):
    return F.concat(F.translate(parent, ".#", "//"), F.when(k % 3 == 0, ".ts").when(k % 7 == 0, "Test.java").otherwise(".java"))


def line_of(k):
    return (k % 1000 + 1).cast("int")


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """``fqn, kind, parent_fqn, file_path, start_line, deleted``."""
    n, m = nations(spark, d), members(spark, d)
    none = F.lit(None).cast("string")
    parts = [n.select(F.col("region_fqn").alias("fqn"), F.lit("package").alias("kind"), none.alias("parent_fqn"), F.lit(0).cast("long").alias("k")).distinct(), n.select(F.col("nation_fqn").alias("fqn"), F.lit("class").alias("kind"), F.col("region_fqn").alias("parent_fqn"), F.col("n_nationkey").cast("long").alias("k"))]
    parts += [df.select("fqn", F.lit("test" if kind == "supplier" else "method").alias("kind"), F.col("nation_fqn").alias("parent_fqn"), "k") for kind, df in m.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    k = F.col("k")
    return out.select("fqn", "kind", "parent_fqn", file_of(F.coalesce("parent_fqn", "fqn"), k).alias("file_path"), line_of(k).alias("start_line"), (k % 11 == 10).alias("deleted"))


def edges(spark: SparkSession, d: str, placed: bool = False) -> DataFrame:
    """``src, dst, edge_type, confidence, site_line``, distinct; if ``placed`` as a parser meets them, maybe repeated, and with ``parent_fqn, start_line`` of the source's symbol, which each kind's rows have."""
    n, m = nations(spark, d), members(spark, d)
    o, li = read(spark, d, "orders"), read(spark, d, "lineitem")
    one, zero = F.lit(1.0), F.lit(0)
    at = lambda parent, k: [parent.alias("parent_fqn"), line_of(k).alias("start_line")] if placed else []
    by_order = lambda k: at(F.split_part("src", F.lit("#"), F.lit(1)), F.col(k))
    c, s, p = m["customer"], m["supplier"], m["part"]
    orders = o.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("ck"), order_fqn().alias("src"))
    # lines are made distinct on their keys before names are built; one exchange by order serves that, the join and both kinds of edges.
    # Other edges come from rows with a key of their own, and no two kinds have equal rows
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax"]
    once = lambda df, of: df if placed else df.dropDuplicates(of)
    lines = once(li.select(*keys).repartition("l_orderkey"), keys).join(orders, F.col("l_orderkey") == orders.ok)
    part_lines, supplier_lines = (once(lines, ["l_orderkey", "src", "l_linenumber", *k]) for k in (("l_partkey", "l_discount"), ("l_suppkey", "l_tax")))
    parts = [
        n.select(F.col("nation_fqn").alias("src"), F.col("region_fqn").alias("dst"), F.lit("extends").alias("edge_type"), one.alias("confidence"), zero.alias("site_line"), *at(F.col("region_fqn"), F.col("n_nationkey").cast("long"))),
        c.select(F.col("fqn").alias("src"), F.col("nation_fqn").alias("dst"), F.lit("extends").alias("edge_type"), one.alias("confidence"), zero.alias("site_line"), *at(F.col("nation_fqn"), F.col("k"))),
        s.select(F.col("fqn").alias("src"), F.col("nation_fqn").alias("dst"), F.lit("implements").alias("edge_type"), one.alias("confidence"), zero.alias("site_line"), *at(F.col("nation_fqn"), F.col("k"))),
        orders.join(c, orders.ck == c.k).select("src", F.col("fqn").alias("dst"), F.lit("calls").alias("edge_type"), one.alias("confidence"), zero.alias("site_line"), *by_order("ok")),
        part_lines.join(p, part_lines.l_partkey == p.k).select("src", F.col("fqn").alias("dst"), F.lit("calls").alias("edge_type"), (1 - F.col("l_discount")).alias("confidence"), F.col("l_linenumber").alias("site_line"), *by_order("l_orderkey")),
        supplier_lines.join(s, supplier_lines.l_suppkey == s.k).select("src", F.col("fqn").alias("dst"), F.lit("injects").alias("edge_type"), (1 - F.col("l_tax")).alias("confidence"), F.col("l_linenumber").alias("site_line"), *by_order("l_orderkey")),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def graph_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges and symbols written as tables, as a traversal reads them more than once."""
    return settled(edges(spark, d)), settled(symbols(spark, d))


SQL = """
nat AS (SELECT n_nationkey, 'geo.' || r_name AS region_fqn, 'geo.' || r_name || '.' || n_name AS nation_fqn FROM nation JOIN region ON n_regionkey = r_regionkey),
mem AS (
 SELECT 'customer' AS t, c_custkey AS k, nation_fqn AS parent, nation_fqn || '#customer_' || c_custkey || '(' || c_mktsegment || ')' AS fqn FROM customer JOIN nat ON c_nationkey = n_nationkey
 UNION ALL SELECT 'supplier', s_suppkey, nation_fqn, nation_fqn || '#supplier_' || s_suppkey || '()' FROM supplier JOIN nat ON s_nationkey = n_nationkey
 UNION ALL SELECT 'part', p_partkey, 'catalog.' || p_brand, 'catalog.' || p_brand || '#part_' || p_partkey || '(' || p_size || ')' FROM part
 UNION ALL SELECT 'order', o_orderkey, 'sales.y' || year(o_orderdate), 'sales.y' || year(o_orderdate) || '#order_' || o_orderkey || '(' || o_orderstatus || ')' FROM orders),
sym0 AS (
 SELECT DISTINCT region_fqn AS fqn, 'package' AS kind, CAST(NULL AS VARCHAR) AS parent_fqn, 0::BIGINT AS k FROM nat
 UNION ALL SELECT nation_fqn, 'class', region_fqn, n_nationkey FROM nat
 UNION ALL SELECT fqn, CASE WHEN t = 'supplier' THEN 'test' ELSE 'method' END, parent, k FROM mem),
symbols AS (SELECT fqn, kind, parent_fqn, translate(coalesce(parent_fqn, fqn), '.#', '//') || CASE WHEN k % 3 = 0 THEN '.ts' WHEN k % 7 = 0 THEN 'Test.java' ELSE '.java' END AS file_path, (k % 1000 + 1)::INT AS start_line, k % 11 = 10 AS deleted FROM sym0),
edges AS (
 SELECT nation_fqn AS src, region_fqn AS dst, 'extends' AS edge_type, 1.0::DOUBLE AS confidence, 0 AS site_line FROM nat
 UNION SELECT fqn, parent, 'extends', 1.0, 0 FROM mem WHERE t = 'customer'
 UNION SELECT fqn, parent, 'implements', 1.0, 0 FROM mem WHERE t = 'supplier'
 UNION SELECT a.fqn, b.fqn, 'calls', 1.0, 0 FROM orders JOIN mem a ON a.t = 'order' AND a.k = o_orderkey JOIN mem b ON b.t = 'customer' AND b.k = o_custkey
 UNION SELECT a.fqn, b.fqn, 'calls', 1 - l_discount, l_linenumber FROM lineitem JOIN mem a ON a.t = 'order' AND a.k = l_orderkey JOIN mem b ON b.t = 'part' AND b.k = l_partkey
 UNION SELECT a.fqn, b.fqn, 'injects', 1 - l_tax, l_linenumber FROM lineitem JOIN mem a ON a.t = 'order' AND a.k = l_orderkey JOIN mem b ON b.t = 'supplier' AND b.k = l_suppkey),
weights(wt, weight) AS (VALUES """ + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in WEIGHTS.items()) + """),
hints AS (SELECT src, edge_type, site_line, dst AS truth, CASE site_line % 8 WHEN 0 THEN dst WHEN 1 THEN pre WHEN 2 THEN regexp_replace(pre, '^.*\\.', '') WHEN 3 THEN mb WHEN 4 THEN 'org.lib.' || mb WHEN 5 THEN '#' || mb WHEN 6 THEN 'wrong.pkg.' || regexp_replace(pre, '^.*\\.', '') ELSE 'kids.' || regexp_replace(split_part(pre, '#', 1), '^.*\\.', '') || '#' || regexp_replace(pre, '^[^#]*#', '') END AS hint FROM (SELECT *, split_part(dst, '(', 1) AS pre, regexp_replace(split_part(dst, '(', 1), '^.*#', '') AS mb FROM edges)),
supers AS (SELECT DISTINCT 'kids.' || x AS fqn, 'mids.' || x AS ancestor FROM (SELECT regexp_replace(split_part(fqn, '#', 1), '^.*\\.', '') AS x FROM symbols) UNION SELECT DISTINCT 'mids.' || regexp_replace(split_part(fqn, '#', 1), '^.*\\.', ''), split_part(fqn, '#', 1) FROM symbols)
"""


def hints(e: DataFrame) -> DataFrame:
    """Edges with their targets written in one of eight ways: full name, prefix, ``Type#member``, member, member of an unknown package, ``#member``, ``Type#member`` in a wrong package, member of a subtype."""
    prefix = F.split_part(F.col("dst"), F.lit("("), F.lit(1))
    simple, member = F.regexp_replace(prefix, r"^.*\.", ""), F.regexp_replace(prefix, "^.*#", "")
    kind = F.col("site_line") % 8
    inherited = F.concat(F.lit("kids."), F.regexp_replace(F.split_part(prefix, F.lit("#"), F.lit(1)), r"^.*\.", ""), F.lit("#"), F.regexp_replace(prefix, "^[^#]*#", ""))
    hint = F.when(kind == 0, F.col("dst")).when(kind == 1, prefix).when(kind == 2, simple).when(kind == 3, member).when(kind == 4, F.concat(F.lit("org.lib."), member)).when(kind == 5, F.concat(F.lit("#"), member)).when(kind == 6, F.concat(F.lit("wrong.pkg."), simple)).otherwise(inherited)
    return e.select("src", "edge_type", "site_line", F.col("dst").alias("truth"), hint.alias("hint"), *[c for c in ("parent_fqn", "start_line") if c in e.columns])


def supers(s: DataFrame) -> DataFrame:
    """``fqn, ancestor``: two subtypes, one above the other, of every type."""
    t = s.select(F.split_part("fqn", F.lit("#"), F.lit(1)).alias("t")).distinct().withColumn("x", F.regexp_replace("t", r"^.*\.", ""))
    return t.select(F.concat(F.lit("kids."), "x").alias("fqn"), F.concat(F.lit("mids."), "x").alias("ancestor")).unionByName(t.select(F.concat(F.lit("mids."), "x").alias("fqn"), F.col("t").alias("ancestor"))).distinct()
