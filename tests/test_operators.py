"""Operators on small inputs made by hand."""

from pyspark.sql import functions as F

from quillon.functions import names
from quillon.operators import evaluation, graph, incremental, ranking, resolve

EDGE = "src string, dst string, edge_type string, confidence double, site_line int"


def test_impact_ends_on_cycles_and_leaves_out_seeds(spark):
    e = spark.createDataFrame([("b", "a", "calls", 1.0, 1), ("c", "b", "calls", 1.0, 1), ("a", "c", "calls", 1.0, 1), ("a", "a", "calls", 1.0, 1)], EDGE)
    got = {r.fqn: (r.score, r.depth) for r in graph.impact(e, spark.createDataFrame([("a",)], "fqn string"), depth=5).collect()}
    assert got == {"b": (0.9, 1), "c": (0.81, 2)}


def test_impact_grows_with_depth_and_shrinks_with_the_floor(spark):
    e = spark.createDataFrame([(f"n{i + 1}", f"n{i}", "calls", 1.0, 1) for i in range(6)], EDGE)
    s = spark.createDataFrame([("n0",)], "fqn string")
    n = [graph.impact(e, s, depth=k).count() for k in (1, 2, 4)]
    assert n == [1, 2, 4]
    assert graph.impact(e, s, depth=4, floor=0.8).count() == 2


def test_fan_out_cap_and_body_only(spark):
    rows = [(f"s{i:03d}", "hub", "calls", 0.5 + i / 1000, 1) for i in range(201)] + [("t", "hub", "extends", 1.0, 1)]
    e = spark.createDataFrame(rows, EDGE)
    assert graph.capped(graph.weighted(e)).count() == 200
    s = spark.createDataFrame([("hub",)], "fqn string")
    assert "t" in {r.fqn for r in graph.impact(e, s).collect()}
    assert "t" not in {r.fqn for r in graph.impact(e, s, body_only=True).collect()}


def test_resolve_counts_candidates(spark):
    names_ = ["a.T#m(int)", "a.T#m(long)", "b.U#k()", "c.V#k2()"] + [f"p{i}.W{i}#five()" for i in range(5)]
    s = spark.createDataFrame([(x,) for x in names_], "fqn string")
    h = spark.createDataFrame([("x", "calls", 1, t, "") for t in ("a.T#m(int)", "a.T#m", "U#k", "k2", "five", "org.lib.z")], "src string, edge_type string, site_line int, hint string, truth string")
    got = {}
    for r in resolve.resolve(h, s).collect():
        got.setdefault(r.hint, []).append((r.tier, round(r.confidence, 3)))
    assert got == {"a.T#m(int)": [("exact", 1.0)], "a.T#m": [("prefix", 0.45)] * 2, "U#k": [("simple", 0.7)], "k2": [("member", 0.6)], "five": [("unresolved", 0.0)], "org.lib.z": [("external", 0.0)]}


def test_names(spark):
    df = spark.createDataFrame([("OrderServiceURLParser", "a.B<C<D>>#m(int)")], "a string, b string")
    r = df.select(names.name_tokens(F.col("a")).alias("t"), names.fqn_shape(F.col("b")).alias("s"), names.module_of(F.lit("svc/x/src/a")).alias("m")).first()
    assert (r.t, r.s, r.m) == (["order", "service", "url", "parser"], "a.B#m", "svc/x")


def test_fill_passes_over_what_is_too_large(spark):
    c = spark.createDataFrame([(1, "a", 1.0, 5, "x", 0), (1, "big", 0.9, 100, "x", 1), (1, "c", 0.2, 5, "x", 2), (1, "low", 0.1, 1, "x", 3)], "request_id long, item string, score double, tokens long, component string, position long")
    assert {r.item: r.reason for r in ranking.filled(c, 12).collect()} == {"a": "selected", "big": "budget exhausted at 12 tokens", "c": "selected", "low": "below floor (0.15)"}
    assert [r.item for r in ranking.filled(c, 112, ordered=True).collect() if r.included] == ["a", "big", "c", "low"]
    assert ranking.filled(c, 12, spent=8).where("included").count() == 0


def test_fill_folds_many_requests_in_one_pass(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # requests go over the ends of batches
    try:
        k = F.col("id")
        c = spark.range(4000).select(F.when(k % 4 > 0, k % 400).alias("request_id"), k.alias("item"), ((k % 89) / 89).alias("score"), (k % 50 + 1).alias("tokens"), F.concat(F.lit("c"), (k % 3).cast("string")).alias("component"), k.alias("position"))
        told = ranking.filled(c, 40)
        assert "FlatMapGroupsInPandas" not in told._jdf.queryExecution().executedPlan().toString()  # a call for each request takes hours with millions of them
        got = {(r.request_id, r.item): r.reason for r in told.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    requests = {}
    for r in c.collect():
        requests.setdefault(r.request_id, []).append(r)
    assert len(requests) == 301 and len(requests[None]) == 1000 and len(got) == 4000
    for key, rows in requests.items():
        used, count = 0, {}
        for r in sorted(rows, key=lambda r: (-r.score / r.tokens, r.position)):
            if r.score < 0.15:
                why = "below floor (0.15)"
            elif count.get(r.component, 0) >= 3:
                why = f"at most 3 items from {r.component}"
            elif used + r.tokens > 40:
                why = "budget exhausted at 40 tokens"
            else:
                why, used = "selected", used + r.tokens
                count[r.component] = count.get(r.component, 0) + 1
            assert got[key, r.item] == why


def test_renames_decline_boilerplate(spark):
    t = "fqn string, name string, sig_hash string, body_hash string"
    a = spark.createDataFrame([("p.A", "A", "1", "1"), ("p.X", "X", "2", "2"), ("q.X", "X", "2", "2")], t)
    b = spark.createDataFrame([("r.A", "A", "1", "1"), ("s.X", "X", "2", "2")], t)
    assert [tuple(r) for r in incremental.renames(a, b).collect()] == [("p.A", "r.A")]


def test_lifecycle(spark):
    p = spark.createDataFrame([("f", i, v) for i, v in enumerate([False, True, True, False, False, True])], "fingerprint string, scan_id int, present boolean")
    assert [r.status for r in incremental.lifecycle(p).orderBy("scan_id").collect()] == ["NEW", "RECURRING", "FIXED", "ABSENT", "REGRESSED"]


def test_wilson(spark):
    low, high = evaluation.wilson(F.lit(80.0), F.lit(100.0))
    r = spark.range(1).select(low.alias("l"), high.alias("h")).first()
    assert (round(r.l, 6), round(r.h, 6)) == (0.711169, 0.866634)


HINT = "src string, edge_type string, site_line int, hint string, src_path string"


def ladder(spark, symbols, hints, supers=()):
    h = spark.createDataFrame([("s", "calls", i, x, p) for i, (x, p) in enumerate(hints)], HINT)
    above = spark.createDataFrame(list(supers), "fqn string, ancestor string")
    rows = resolve.resolve(h, spark.createDataFrame([(x,) for x in symbols], "fqn string"), above).orderBy("site_line", "dst").collect()
    return [(r.hint, r.dst, r.tier, r.resolution, round(r.confidence, 4)) for r in rows]


def test_ladder_of_names_members_and_packages(spark):
    symbols = ["com.acme.T", "com.acme.T#m(int)", "com.acme.U#go()", "com.acme.o.V#f(int)", "com.acme.o.V#f(long)", "rs::mod::W#run()", "com.acme.o.X#get()"] + [f"com.acme.p.Y{i}#busy()" for i in range(5)]
    hints = ["com.acme.T", "com.acme.T#m", "com.acme.o.V#f", "#m", "#go", "go", "wrong.pkg.T#m", "other::W#run", "f", "busy", "com.acme.Z#q", "com.zeta.Z#q", "com.acme.far.Z#q", "plain", None]
    got = ladder(spark, symbols, [(h, None) for h in hints])
    of = lambda h: [x[1:] for x in got if x[0] == h]
    assert of("com.acme.T") == [("com.acme.T", "exact", "exact", 1.0)]
    assert of("com.acme.T#m") == [("com.acme.T#m(int)", "prefix", "heuristic", 0.9)]
    assert of("com.acme.o.V#f") == [("com.acme.o.V#f(int)", "prefix", "heuristic", 0.45), ("com.acme.o.V#f(long)", "prefix", "heuristic", 0.45)]
    assert of("#m") == [("com.acme.T#m(int)", "member", "heuristic", 0.6)]
    assert of("#go") == of("go") == [("com.acme.U#go()", "member", "heuristic", 0.6)]
    assert of("wrong.pkg.T#m") == [("com.acme.T#m(int)", "simple", "heuristic", 0.7)]
    assert of("other::W#run") == [("rs::mod::W#run()", "simple", "heuristic", 0.7)]
    assert [x[3] for x in of("f")] == [0.3, 0.3]
    assert of("busy") == of("plain") == of("com.acme.Z#q") == of(None) == [(None, "unresolved", "unresolved", 0.0)]
    assert of("com.zeta.Z#q") == [(None, "external", "external", 0.0)]
    assert of("com.acme.far.Z#q") == [(None, "sibling", "sibling", 0.0)]


def test_ladder_of_supertypes(spark):
    symbols = ["a.b.Base#id()", "a.b.Two#x(int)", "a.b.Two#x(long)", "a.b.Child", "a.b.Grand", "a.b.Repo", "a.b.Loop"]
    supers = [("a.b.Child", "a.b.Base"), ("a.b.Grand", "a.b.Child"), ("a.b.Child", "a.b.Two"), ("a.b.Repo", "org.data.Repo"), ("a.b.Loop", "a.b.Loop")]
    got = ladder(spark, symbols, [(h, None) for h in ("a.b.Child#id", "a.b.Grand#id", "a.b.Grand#x", "a.b.Repo#save", "a.b.Loop#no")], supers)
    assert [x[1:] for x in got] == [("a.b.Base#id()", "inherited", "heuristic", 0.85)] * 2 + [(None, "unresolved", "unresolved", 0.0), (None, "external", "external", 0.0), (None, "unresolved", "unresolved", 0.0)]


def test_ladder_of_graphql_names(spark):
    symbols = [f"graphql:svc{i}/backend:Query.q" for i in range(6)] + ["graphql:one/x:Query.solo", "graphql:Query.bare"]
    hints = [("graphql:Query.q", "svc3/front/a.ts"), ("graphql:Query.q", "else/a.ts"), ("graphql:Query.solo", "z/a.ts"), ("graphql:Query.bare", "z/a.ts"), ("graphql:Query.none", "z/a.ts")]
    got = ladder(spark, symbols, hints)
    assert got[0][1:] == ("graphql:svc3/backend:Query.q", "graphql", "contract", 0.95)
    assert [x[4] for x in got[1:7]] == [0.1667] * 6 and {x[3] for x in got[1:7]} == {"heuristic"}
    assert [x[2:] for x in got[7:]] == [("graphql", "contract", 0.95), ("contract", "contract", 0.95), ("unresolved", "unresolved", 0.0)]


def test_package_root_needs_more_than_half(spark):
    root = lambda *p: [r.root for r in resolve.package_root(spark.createDataFrame([(x,) for x in p], "pkg string")).collect()]
    assert root("mn.auto.a", "mn.auto.b", "com.x.y") == ["mn.auto"] and root("mn.auto.a", "com.x.y") == [] and root("geo", "sales") == []


def test_test_code_and_shapes(spark):
    cases = {("a/tests/b.rs", "x"): True, ("a/Test.java", "x"): False, ("a.spec.ts", "x"): True, ("a.spec.js", "x"): False, ("b", "OrderTest#m"): True, ("b", "p.OrderTests"): True, ("b", "p.Contest"): False, ("b", "p#test_it"): False}
    rows = spark.createDataFrame([(p, f, w) for (p, f), w in cases.items()], "p string, f string, w boolean")
    assert rows.where(names.is_test(F.col("p"), F.col("f")) != F.col("w")).count() == 0
    shape = spark.createDataFrame([("a.T<B<C<D<E>>>>#m(List<X>)",)], "f string").select(names.fqn_shape(F.col("f"))).first()[0]
    assert shape == "a.T#m"


def test_upsert_and_diff_with_nulls(spark):
    kind = "k int, s string, v double"
    got = incremental.upsert(spark.createDataFrame([(1, "x", 1.0), (4, "y", None)], kind), spark.createDataFrame([(1, None, 2.0), (2, None, 3.0)], kind), "k")
    assert sorted(map(tuple, got.collect())) == [(1, None, 2.0), (2, None, 3.0), (4, "y", None)]
    row = "fqn string, sig_hash string, body_hash string, annotations array<string>"
    old = [("same", None, "b", ["x", "y"]), ("body", None, "b", None), ("contract", "s", "b", ["t"]), ("gone", None, None, None), ("api", "s", "b", ["t"])]
    new = [("same", None, "b", ["y", "x"]), ("body", None, None, None), ("contract", "s", "c", []), ("new", None, None, None), ("api", None, "b", [])]
    got = incremental.symbol_diff(spark.createDataFrame(old, row), spark.createDataFrame(new, row))
    assert {r.fqn: r.change for r in got.collect()} == {"body": "body", "contract": "contract", "gone": "removed", "new": "added", "api": "api"}


def test_calibration_by_tier_and_claim(spark):
    rows = [("a", 0.62, True)] * 2 + [("a", 0.68, False)] * 2
    judged = spark.createDataFrame(rows, "tier string, confidence double, correct boolean")
    assert round(evaluation.brier_ece(judged).first().ece, 4) == 0.53
    many = spark.createDataFrame([("t", 0.9, i < 120) for i in range(120)] + [("u", 0.5, True)] * 12 + [("w", 0.5, i % 2 == 0) for i in range(400)], judged.schema)
    got = {r.tier: (r.verdict, r.proposed and round(r.proposed, 4)) for r in evaluation.calibration(many).collect()}
    assert got == {"t": ("miscalibrated", round(120.5 / 121, 4)), "u": ("under_powered", None), "w": ("ok", None)}


def test_expansion(spark):
    e = spark.createDataFrame([("b", "a", "calls", 1.0, 1), ("a", "c", "calls", 0.5, 1)], EDGE)
    got = {r.fqn: r.score for r in graph.both_ways(e, spark.createDataFrame([("a",)], "fqn string")).collect()}
    assert got == {"b": 0.9, "c": 0.45}


def test_report_splits_tests_before_the_limit(spark):
    reached = spark.createDataFrame([("p.A", 0.9, 1), ("p.B", 0.8, 1), ("p.C", 0.8, 2), ("p.CTest", 0.1, 3), ("none", 1.0, 1)], "fqn string, score double, depth int")
    symbols = spark.createDataFrame([(x, "class", "f.java", 1) for x in ("p.A", "p.B", "p.C", "p.CTest")], "fqn string, kind string, file_path string, start_line int")
    got = {r.fqn: (r.test, r.uncovered) for r in graph.report(reached, symbols, 2).collect()}
    assert got == {"p.A": (False, False), "p.B": (False, False), "p.CTest": (True, False)}
    bare = graph.report(reached.where("fqn <> 'p.CTest'"), symbols, 9)
    assert [r.uncovered for r in bare.collect()] == [True] * 3
    assert not any(r.uncovered for r in graph.report(reached.where("fqn = 'p.A'"), symbols, 9, reverse=False).collect())
    assert graph.report(reached.where("false"), symbols).count() == 0
