"""What lives, how it is reached, and the small definitions that an index rests on."""

from pyspark.sql import functions as F

from quillon.operators import graph, incremental, ranking, resolve, views

EDGE = "src string, dst string, edge_type string, confidence double, site_line int, resolution string"
SYMBOL = "fqn string, kind string, parent_fqn string, file_path string, start_line int, deleted boolean"


def names(spark, *fqns):
    return spark.createDataFrame([(x,) for x in fqns], "fqn string")


def symbols(spark, *fqns, dead=()):
    return spark.createDataFrame([(x, "method", "p.A", "f", i, x in dead) for i, x in enumerate([*fqns, *dead])], SYMBOL)


def test_paths_multiply_to_the_score_and_pass_no_deleted_bridge(spark):
    e = spark.createDataFrame([("b", "a", "calls", 0.9, 1, "exact"), ("c", "b", "calls_http", 0.8, 1, "contract"), ("x", "a", "calls", 1.0, 1, "exact"), ("d", "x", "calls", 1.0, 1, "exact"), ("d", "c", "calls", 1.0, 1, "exact"), ("c", "a", "imports", 1.0, 1, "exact"), ("a", "d", "calls", 1.0, 1, "exact"), ("nowhere", "a", "calls", 1.0, 1, "exact"), ("n", "a", "calls", None, 1, "exact")], EDGE)
    s = symbols(spark, "a", "b", "c", "d", "n", dead=["x"])
    found = graph.traverse(e, names(spark, "a", "a"), s)
    got = {r.fqn: r for r in found.reached.collect()}
    assert set(got) == {"b", "c", "d"} and found.crossed == 1 and found.truncated.count() == 0
    for r in got.values():
        product = 1.0
        for hop in r.path:
            product *= graph.WEIGHTS[hop.edge] * hop.confidence
        assert abs(product - r.score) < 1e-12 and min(h.confidence for h in r.path) == r.min_confidence and len(r.path) == r.depth and r.path[0]["from"] == "a"
    assert [(h["from"], h.edge, h.resolution) for h in got["d"].path] == [("a", "calls", "exact"), ("b", "calls_http", "contract"), ("c", "calls", "exact")]
    # c is reached at once over an import, and better at the second step; x, deleted, leads nowhere
    assert (got["c"].depth, got["c"].score) == (2, 0.9 * 0.9 * 0.85 * 0.8)
    assert {r.fqn for r in graph.reachable(e, names(spark, "a"), 5, s).collect()} == {"b", "c", "d", "n"}
    assert {r.fqn for r in graph.traverse(e, names(spark, "a")).reached.collect()} == {"b", "c", "d", "x", "nowhere"}
    assert graph.traverse(e, names(spark), s).reached.count() == 0 and graph.traverse(e, names(spark, "none"), s).reached.count() == 0


def test_truncation_is_told_and_ties_go_by_name(spark):
    rows = [(f"s{i:02d}", "hub", "calls", 0.5, i, None) for i in range(9)] + [("t", "s01", "calls", 1.0, 1, None), ("t", "s00", "calls", 1.0, 1, None)]
    found = graph.traverse(spark.createDataFrame(rows, EDGE), names(spark, "hub"), cap=4)
    assert [tuple(r) for r in found.truncated.collect()] == [("hub", 1, 9)]
    got = {r.fqn: r for r in found.reached.collect()}
    assert set(got) == {"s00", "s01", "s02", "s03", "t"} and got["t"].path[1]["from"] == "s00"
    both = graph.expand(spark.createDataFrame(rows, EDGE), names(spark, "s00"), "explain").reached
    assert {r.fqn for r in both.collect()} == {"hub", "t"} and {r.fqn for r in graph.expand(spark.createDataFrame(rows, EDGE), names(spark, "s00"), "debug").reached.collect()} == {"hub"}


def test_views_show_what_lives(spark):
    e = spark.createDataFrame([("a", "b", "calls", 1.0, 1, "exact"), ("x", "b", "calls", 1.0, 1, "exact"), ("a", "x", "calls", 1.0, 2, "exact"), ("a", None, "calls", 0.0, 3, "external")], EDGE)
    s = symbols(spark, "a", "b", dead=["x", "p.A"])
    assert [(r.fqn, r.other) for r in views.edges_into(s, e, names(spark, "b", "x")).collect()] == [("b", "a"), ("x", "a")]
    assert [(r.fqn, r.other) for r in views.edges_out(s, e, names(spark, "a")).collect()] == [("a", "b")]
    assert sorted((r.src, r.dst or "", r.site_line) for r in views.edge_facts(s, e).collect()) == [("a", "", 2), ("a", "", 3), ("a", "b", 1)]
    assert sorted((r.fqn, r.parent_fqn) for r in views.symbol_facts(s).collect()) == [("a", "p.A"), ("b", "p.A")]
    far = s.unionByName(spark.createDataFrame([("z", "class", None, "g", 1, False)], SYMBOL))
    more = e.unionByName(spark.createDataFrame([("z", "a", "calls", 1.0, 1, "exact")], EDGE))
    assert {r.fqn for r in views.symbol_facts_in(far, more, spark.createDataFrame([("g",)], "path string")).collect()} == {"z", "a"}
    old = spark.createDataFrame([("was", "b"), ("older", "was")], "old_fqn string, new_fqn string")
    got = {(r.asked, r.fqn, r.way, r.other) for r in views.symbol_detail(s, e, names(spark, "older", "a", "gone"), old).collect()}
    assert got == {("older", "b", "in", "a"), ("a", "a", "out", "b")}
    assert {(r.fqn, r.old_fqn) for r in views.old_names(old, names(spark, "b", "a")).collect()} == {("b", "was"), ("b", "older")}
    counted = e.withColumn("hint", F.lit("h"))
    assert tuple(views.edge_counts(counted).first()) == (4, 3, 1, 0, 0) and tuple(views.edge_counts(counted.limit(0)).first()) == (0, 0, 0, 0, 0)
    hints = spark.createDataFrame([("a", "calls", 1, "x"), ("a", "calls", 2, "b"), ("a", "calls", 3, None)], "src string, edge_type string, site_line int, hint string")
    assert {r.hint: r.tier for r in resolve.resolve(hints, s).collect()} == {"x": "unresolved", "b": "exact", None: "unresolved"}
    assert resolve.resolve(hints.limit(0), s).count() == 0 and {r.tier for r in resolve.resolve(hints, s.limit(0), old.toDF("fqn", "ancestor").limit(0)).collect()} == {"unresolved"}


def test_fill_of_unknown_sizes_and_ids_of_any_type(spark):
    c = spark.createDataFrame([("r", 1, 1.0, None, "x", 0), ("r", 2, 0.9, 5.0, "x", 1), ("r", 3, None, 1.0, None, 2), ("r", 4, 0.9, 6.0, "x", 3), ("r", 6, 0.8, -3.0, "y", 5), ("r", 5, 0.9, 5.0, "y", 1)], "request_id string, item int, score double, tokens double, component string, position int")
    got = {r.item: r.reason for r in ranking.filled(c, 11).collect()}
    assert got == {1: "unknown size", 2: "selected", 3: "below floor (0.15)", 4: "budget exhausted at 11 tokens", 5: "selected", 6: "selected"}
    assert ranking.filled(c.limit(0), 11).collect() == []


def test_lifecycles_and_ties(spark):
    p = spark.createDataFrame([("f", 1, True), ("f", 1, True), ("f", 2, False), ("f", 2, None), ("f", 3, False), ("f", 4, True), ("f", 5, True)], "fingerprint string, scan_id int, present boolean")
    want = [("f", 1, "NEW"), ("f", 2, "FIXED"), ("f", 3, "ABSENT"), ("f", 4, "REGRESSED"), ("f", 5, "RECURRING")]
    assert sorted(map(tuple, incremental.lifecycle(p).collect())) == want
    seen = p.where("present").select("fingerprint", "scan_id", F.lit(7).alias("scans"))
    assert sorted(map(tuple, incremental.lifecycle_of(seen).collect())) == [*want, ("f", 6, "FIXED"), ("f", 7, "ABSENT")]
    facts = spark.createDataFrame([("k", 1, "b"), ("k", 1, "a"), ("k", 2, "c")], "fact_key string, scan_id int, claim string")
    assert [tuple(r)[2:] for r in incremental.fact_versions(facts).orderBy("scan_id", "claim").collect()] == [("a", 1, False), ("b", 2, False), ("c", None, True)]
    stored = spark.createDataFrame([("c", "F-7"), ("c", "F-x")], "cap string, uid string")
    new = spark.createDataFrame([("c", i % 3) for i in range(40)] + [("d", 1)], "cap string, at int").repartition(5)
    rows = incremental.display_ids(stored, new, "cap", "F-", "at").collect()
    n = sorted((int(r.uid[2:]), r["at"]) for r in rows if r.cap == "c")
    assert [x[0] for x in n] == list(range(8, 48)) and [x[1] for x in n] == sorted(x[1] for x in n) and [r.uid for r in rows if r.cap == "d"] == ["F-1"]
    d = spark.createDataFrame([(None, ["a"]), ("a", ["a"]), ("a.b", ["a"]), ("a", ["a.b"]), ("a", ["ab"]), ("z", None), ("a#m", ["a#m(x)", "q"])], "s string, seeds array<string>")
    assert [r.m for r in d.select(ranking.subject_match(F.col("s"), F.col("seeds")).alias("m")).collect()] == [0.3, 1.0, 0.6, 0.6, 0.3, 0.3, 0.6]
