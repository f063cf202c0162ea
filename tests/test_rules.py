"""Rules, states, lookups and sinks on small inputs made by hand, with nulls and empty tables."""

from pyspark.sql import functions as F

from quillon.functions import names
from quillon.operators import incremental, lookup, rules, states

SYMBOL = "fqn string, kind string, parent_fqn string, file_path string, visibility string, annotations array<string>"
EDGE = "src string, dst string, edge_type string"


def symbols(spark):
    return spark.createDataFrame([("a.S", "class", None, "S.java", "public", ["@Service"]), ("a.S#pay()", "method", "a.S", "S.java", None, ["Transactional(x)"]), ("a.S#go()", "method", "a.S", "S.java", "public", None), ("a.P#tx()", "method", "a.P", "P.java", "private", ["@Transactional"]), ("ui.V", "class", None, "v.ts", None, None), ("ui.Old", "class", None, "o.tsx", None, None)], SYMBOL)


def test_detectors(spark):
    s = symbols(spark)
    e = spark.createDataFrame([("a.S#go()", "a.S#pay()", "calls"), ("a.S#pay()", "a.S#pay()", "calls"), ("ui.V", "a.S#pay()", "calls"), (None, "a.S#pay()", "calls")], EDGE)
    assert [tuple(r) for r in rules.transactional_non_public(s).collect()] == [("a.S#pay()", "package-private")]
    assert [tuple(r) for r in rules.self_invocation(s, e).collect()] == [("a.S#go()", "a.S#pay()")]
    assert rules.self_invocation(s.where("false"), e).count() == 0
    asked = spark.createDataFrame([("ui.V", "graphql:Query.x"), ("ui.V", "graphql:op:y"), ("ui.V", None)], "src string, hint string")
    assert rules.orphan_operations(s, asked).count() == 0  # nothing is served
    served = s.unionByName(spark.createDataFrame([("graphql:Query.z", "route", None, "g", None, None)], SYMBOL))
    assert [tuple(r) for r in rules.orphan_operations(served, asked).collect()] == [("ui.V", "Query.x")]


def test_review_rules(spark):
    s = symbols(spark)
    e = spark.createDataFrame([("a.S#go()", "a.S#pay()", "calls"), ("ui.V", "a.S#go()", "calls"), ("ui.Old", "a.S#go()", "calls"), ("x", "a.S#pay()", "calls"), ("y", "a.S#pay()", "calls"), ("a.S#pay()", "ui.V", "calls")], EDGE)
    changed = spark.createDataFrame([("a.S#pay()", "CONTRACT_CHANGED"), ("ui.Old", "BODY_CHANGED"), ("none", "API_CHANGED")], "fqn string, kind string")
    assert [tuple(r) for r in rules.seam_crossing(s, e, changed).collect()] == [("a.S#pay()", 1)]
    assert rules.stale_callers(s, e, changed).count() == 0  # annotations alone don't make callers stale
    api = changed.withColumn("kind", F.lit("API_CHANGED"))
    assert [tuple(r) for r in rules.stale_callers(s, e, api).collect()] == [("a.S#pay()", 3)]
    assert [tuple(r) for r in rules.untested_changes(s, e, changed).collect()] == [("a.S#pay()", 5)]
    covered = spark.createDataFrame([("a.S#pay()",)], "fqn string")
    assert rules.untested_changes(s, e, changed, covered).count() == 0
    assert rules.seam_crossing(s, e.where("false"), changed).count() == 0


def test_pairs_are_numbers_unless_two_names_share_one(spark, monkeypatch):
    s = symbols(spark)
    e = spark.createDataFrame([("ui.V", "a.S#pay()", "calls"), ("a.S#go()", "ui.V", "calls"), (None, "a.S#pay()", "calls")], EDGE)
    changed = spark.createDataFrame([("a.S#pay()", "CONTRACT_CHANGED")], "fqn string, kind string")
    pairs, _ = rules.reached_by(e, changed.select("fqn"), 4, s)
    assert dict(pairs.dtypes) == {"seed": "bigint", "node": "bigint", "depth": "int"} and pairs.count() == 2
    monkeypatch.setattr(rules, "number", lambda name: F.length(name) % 2)
    pairs, _ = rules.reached_by(e, changed.select("fqn"), 4, s)
    assert sorted(map(tuple, pairs.collect())) == [("a.S#pay()", "a.S#go()", 2), ("a.S#pay()", "ui.V", 1)]
    assert [tuple(r) for r in rules.seam_crossing(s, e, changed).collect()] == [("a.S#pay()", 1)]
    assert [tuple(r) for r in rules.untested_changes(s, e, changed).collect()] == [("a.S#pay()", 2)]


def test_states(spark):
    checks = spark.createDataFrame([(1, True, None), (1, None, None), (2, False, False), (3, True, True)], "id int, failed boolean, blocked boolean")
    assert {r.id: r.outcome for r in states.outcome(checks, "id").collect()} == {1: "failed", 2: "passed", 3: "unknown"}
    pairs = [("passed", "passed", "verified"), ("passed", "failed", "failed"), ("failed", "failed", "inconclusive"), ("failed", "passed", "verified"), ("unknown", "passed", "inconclusive"), (None, "failed", "failed"), (None, None, "inconclusive")]
    rows = spark.createDataFrame(pairs, "b string, h string, want string")
    assert rows.where(states.verdict(F.col("b"), F.col("h")) != F.col("want")).count() == 0
    judged = spark.createDataFrame([("f", 1, True), ("f", 1, False), ("f", 2, True), ("g", 1, False)], "file string, line int, correct boolean")
    got = {r.measure: round(r.value, 4) for r in states.scores(judged, "file", "line").collect()}
    assert got == {"precision": 0.5, "recall": 0.6667, "strict": 0.3333, "f1": 0.5714}
    assert {r.value for r in states.scores(judged.where("false"), "file", "line").collect()} == {0.0}
    names_ = spark.createDataFrame([("catalog.A",), ("catalog",)], "fqn string")
    facts = spark.createDataFrame([("1", "catalog"), ("2", "catalog.A#m"), ("3", "catalog.AB"), ("4", "other"), ("5", None)], "fact_key string, subject string")
    got = {(r.seed, r.fact_key) for r in states.facts_for_seeds(facts, names_).collect()}
    assert got == {("catalog.A", k) for k in "123"} | {("catalog", k) for k in "123"}


def test_lookups(spark):
    s = symbols(spark).withColumn("start_line", F.lit(1))
    find = lambda t: [r.fqn for r in lookup.find_symbols(s, t).collect()]
    assert find("PAY") == ["a.S#pay()"] and find("a.S") == ["a.S"] and find("S.java") == ["a.S", "a.S#go()", "a.S#pay()"] and find("%") == []
    state = lambda t: sorted({r.state for r in lookup.target_state(s, t).collect()})
    assert state("a.S") == ["one"] and state(")") == ["ambiguous"] and state("zzz") == ["not_found"] and state("S.java") == ["one"]
    spans = spark.createDataFrame([("f", "outer", 1, 500), ("f", "inner", 100, 200), ("g", "x", None, None)], "file_path string, fqn string, start_line int, end_line int")
    places = spark.createDataFrame([("f", 150), ("f", 64), ("f", 501), ("g", 1)], "file_path string, line int")
    assert sorted(map(tuple, lookup.symbol_at(spans, places).collect())) == [("f", 64, "outer"), ("f", 150, "inner")]


def test_sinks(spark):
    row = "k int, v string"
    ledger = spark.createDataFrame([(1, "a"), (None, "n")], row)
    got = incremental.append_once(ledger, spark.createDataFrame([(1, "z"), (None, "m"), (2, "b"), (2, "b")], row), "k")
    assert sorted(map(str, got.collect())) == sorted(map(str, spark.createDataFrame([(1, "a"), (None, "n"), (2, "b")], row).collect()))
    renamed = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old_fqn string, new_fqn string")
    got = {r.fqn: r.now for r in incremental.alias_of(renamed, spark.createDataFrame([("a",), ("c",), ("x",)], "fqn string"), 4).collect()}
    assert got == {"a": "c", "c": "c", "x": "x"}
    files = spark.createDataFrame([("f", False), ("g", True), (None, None)], "path string, deleted boolean")
    held = spark.createDataFrame([("s", "f", None), ("t", "h", False)], "fqn string, file_path string, deleted boolean")
    f, s = incremental.mark_deleted(files, held, spark.createDataFrame([("f",), (None,)], "path string"))
    assert {r.path: r.deleted for r in f.collect()} == {"f": True, "g": True, None: False} and {r.fqn: r.deleted for r in s.collect()} == {"s": True, "t": False}


def test_versions_and_slugs(spark):
    rows = spark.createDataFrame([("v1.2.3-x", "1.2.3"), ("none", None), ("a .5", ".5"), ("x 7. y", "7"), ("end 2.", "2")], "line string, want string")
    got = {r.line: r.v for r in rows.select("line", names.extract_version(F.col("line")).alias("v")).collect()}
    assert got == {"v1.2.3-x": "1.2.3", "none": None, "a .5": ".5", "x 7. y": "7", "end 2.": "2"}
