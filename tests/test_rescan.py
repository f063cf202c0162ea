"""A rescan gives the rows of a scan from nothing, and says what changed."""

import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import incremental, rescan, states

TREE = "path string, size long, mtime long, content_hash string"
SYMBOLS = "fqn string, name string, sig_hash string, body_hash string, annotations array<string>, authority string, file_path string"
EDGES = "src string, edge_type string, site_line int, hint string, file_path string"
ANCHORS = "fact_key string, path string, fqn string, sig_hash string, body_hash string"
FACTS = "fact_key string, validated long, validated_scan long, durable boolean, invalidated long"
ALIASES = "old_fqn string, new_fqn string, scan_id long"


def tables(spark, files):
    """``files``: path to (symbols as (fqn, sig, body, authority), edges as (src, type, line, hint))."""
    tree, symbols, edges = [], [], []
    for path, (own, out) in files.items():
        tree.append((path, len(own), 0, str(hash((tuple(own), tuple(out))))))
        symbols += [(f, f.split("#")[-1].split(".")[-1], s, b, None, a, path) for f, s, b, a in own]
        edges += [(*e, path) for e in out]
    return spark.createDataFrame(tree, TREE).withColumn("mtime", F.xxhash64("content_hash")), spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(edges, EDGES)


def rows(index):
    live = index.symbols.where("NOT deleted").drop("deleted").collect()
    return sorted(map(str, live)), sorted(map(str, index.edges.collect())), sorted(r.path for r in index.files.where("NOT deleted").collect())


def fresh(spark, files, anchors=(), facts=()):
    return rescan.scan(*tables(spark, files), spark.createDataFrame(list(anchors), ANCHORS), spark.createDataFrame(list(facts), FACTS), spark.createDataFrame([], ALIASES))


def step(spark, index, files, scan_id=2, **how):
    return rescan.rescan(index, *tables(spark, files), scan_id, **how)


BASE = {
    "a/Caller.java": ([("p.Caller#run()", "s", "b", "declares")], [("p.Caller#run()", "calls", 3, "p.Helper#greet()"), ("p.Caller#run()", "calls", 4, "p.Child#tell()")]),
    "a/Child.java": ([("p.Child", "s", "b", "declares")], []),
    "a/Base.java": ([("p.Base", "s", "b", "declares"), ("p.Base#tell()", "s", "b", "declares")], []),
    "a/Leaf.java": ([("p.Leaf#value()", "s", "b", "declares")], []),
}


def test_changes_that_resolve_edges_elsewhere(spark):
    index = fresh(spark, BASE, [("f1", "a/Leaf.java", "p.Leaf#value()", "s", "b"), ("f2", "a/Base.java", None, None, None), ("f2", "a/Child.java", "p.Child", "s", "b")], [("f1", 0, None, False, None), ("f2", 2, 1, False, None)])
    assert {r.hint: r.tier for r in index.edges.collect()} == {"p.Helper#greet()": "unresolved", "p.Child#tell()": "unresolved"}
    # a body alone: nothing else is resolved again, the fact about it is invalid, the other is durable
    body = BASE | {"a/Leaf.java": ([("p.Leaf#value()", "s", "b2", "declares")], [])}
    one = step(spark, index, body)
    assert one.report == {"unchanged": False, "files_changed": 1, "files_deleted": 0, "symbols_changed": 1, "edges_walked": 0, "facts_invalidated": 1, "facts_validated": 1}
    assert {r.fact_key: (r.validated, r.durable, r.invalidated) for r in one.index.facts.collect()} == {"f1": (0, False, 2), "f2": (3, True, None)}
    assert {tuple(r) for r in one.changes.collect()} == {("file", "a/Leaf.java", None, None, "modified", "content"), ("symbol", "a/Leaf.java", "p.Leaf#value()", None, "modified", "body")}
    # a symbol appears in another file
    late = body | {"b/Helper.java": ([("p.Helper#greet()", "s", "b", "declares")], [])}
    two = step(spark, one.index, late, 3)
    assert two.report["edges_walked"] == 1 and rows(two.index) == rows(fresh(spark, late))
    assert {r.fact_key: r.validated for r in two.index.facts.collect()} == {"f1": 0, "f2": 4}
    # a supertype appears, no symbol does
    above = late | {"a/Child.java": ([("p.Child", "s", "b", "declares")], [("p.Child", "extends", 1, "p.Base")])}
    three = step(spark, two.index, above, 4)
    assert rows(three.index) == rows(fresh(spark, above)) and {r.hint: r.tier for r in three.index.edges.collect()}["p.Child#tell()"] == "inherited"
    # a package moves, and the file with it
    moved = {k.replace("b/", "c/"): v for k, v in above.items()} | {"c/Helper.java": ([("q.Helper#greet()", "s", "b", "declares")], [])}
    four = step(spark, three.index, moved, 5)
    assert rows(four.index) == rows(fresh(spark, moved)) and [tuple(r) for r in four.index.aliases.collect()] == [("p.Helper#greet()", "q.Helper#greet()", 5)]
    assert ("symbol", "c/Helper.java", "q.Helper#greet()", "p.Helper#greet()", "renamed", None) in {tuple(r) for r in four.changes.collect()}
    # nothing
    five = step(spark, four.index, moved, 6)
    assert five.report["unchanged"] and five.changes.count() == 0 and five.index is four.index


def test_a_deleted_declaration_leaves_its_name_to_the_implementation(spark):
    both = {"x/decl": ([("graphql:Query.a", "s", "b", "declares")], []), "x/impl": ([("graphql:Query.a", "s", "i", "implements")], [("graphql:Query.a", "calls", 1, "z.Z")]), "x/z": ([("z.Z", "s", "b", "declares")], [])}
    index = fresh(spark, both)
    assert {r.file_path for r in index.symbols.where("fqn = 'graphql:Query.a'").collect()} == {"x/decl"}
    left = {k: v for k, v in both.items() if k != "x/decl"}
    got = step(spark, index, left)
    assert rows(got.index) == rows(fresh(spark, left)) and got.report["files_changed"] == 1
    # an implementation that comes in again takes no living declaration's name, and that is no change
    edited = both | {"x/impl": ([("graphql:Query.a", "s", "i2", "implements")], both["x/impl"][1])}
    again = step(spark, index, edited)
    assert rows(again.index) == rows(fresh(spark, edited)) and again.changes.where("entity = 'symbol'").count() == 0


@pytest.mark.parametrize("seed, scans", [(1, 1), (2, 2)])
def test_random_trees(spark, seed, scans):
    r = random.Random(seed)
    names = [f"{p}.{t}#{m}({a})" for p in ("p", "q.r") for t in ("A", "B", "C") for m in ("m", "n") for a in ("", "int")] + [f"{p}.{t}" for p in ("p", "q.r") for t in ("A", "B", "C")] + [f"graphql:svc{i}/x:Query.f" for i in range(3)]
    hints = [*names, "p.A#m", "A#m", "m", "#n", "graphql:Query.f", "org.x.Y#m", "p.C#n", None]

    def files(paths):
        free = r.sample(names, 20)
        out = {}
        for path in paths:
            own = [(f, r.choice("st"), r.choice("bc"), "declares") for f in (free.pop() for _ in range(r.randrange(4)) if free)]
            out[path] = (own, [(f, r.choice(["calls", "extends"]) if "#" not in f else "calls", r.randrange(3), r.choice(hints)) for f, *_ in own for _ in range(r.randrange(4))])
        return out

    first = files([f"svc{i % 3}/d{i}/x" for i in range(9)])
    index = fresh(spark, first)
    for scan_id in range(2, 2 + scans):
        # names stay unique over files: a file keeps its own, gives some up or changes them
        second = {}
        for path, (own, out) in first.items():
            if r.random() < 0.2:
                continue
            if r.random() < 0.5:
                own = [(f, s, r.choice("bc"), a) for f, s, _, a in own if r.random() < 0.8]
                out = [e for e in out if r.random() < 0.9 and e[0] in {o[0] for o in own}]
            second[path if r.random() < 0.8 else path + "2"] = (own, out)
        used = {o[0] for own, _ in second.values() for o in own}
        spare = [n for n in names if n not in used]
        second[f"svc1/new{scan_id}"] = ([(n, "s", "b", "declares") for n in spare[:3]], [(spare[0], "calls", 1, r.choice(hints))])
        got = step(spark, index, second, scan_id)
        assert rows(got.index) == rows(fresh(spark, second))
        index, first = got.index, second


def test_empty_trees_deltas_and_gates(spark):
    none = fresh(spark, {})
    assert rows(none) == ([], [], [])
    got = step(spark, none, BASE)
    assert rows(got.index) == rows(fresh(spark, BASE))
    gone = step(spark, got.index, {})
    assert rows(gone.index) == ([], [], []) and gone.report["files_deleted"] == 4
    edited = BASE | {"a/Leaf.java": ([("p.Leaf#v2()", "s", "b", "declares")], []), "a/Base.java": ([], [])}
    part = step(spark, got.index, edited, delta=spark.createDataFrame([("a/Leaf.java",)], "path string"))
    assert part.report["files_changed"] == 1 and part.report["files_deleted"] == 0
    assert step(spark, got.index, BASE, forced=True).report["files_changed"] == 4
    assert rescan.same_revision(("c", False, "1"), ("c", False, "1")) and not rescan.same_revision(("c", False, "1"), ("c", False, "2"))
    assert not rescan.same_revision(("c", True, "1"), ("c", True, "1")) and not rescan.same_revision((None, False, "1"), (None, False, "1"))


def test_replacement_and_anchors(spark):
    kind = "fqn string, file_path string, authority string, deleted boolean"
    stored = spark.createDataFrame([("a", "f", "declares", False), ("b", "g", "declares", False), ("c", "f", "declares", False), ("d", "h", "implements", True), ("e", "h", "implements", False)], kind)
    incoming = spark.createDataFrame([("a", "f", "implements", False), ("b", "f", "implements", False), ("d", "f", "implements", False), ("e", "f", "implements", False)], kind)
    after = incremental.replace_symbols(stored, incoming, spark.createDataFrame([("f",)], "path string"))
    assert sorted(map(tuple, after.collect())) == [("a", "f", "implements", False), ("b", "g", "declares", False), ("c", "f", "declares", True), ("d", "f", "implements", False), ("e", "f", "implements", False)]
    assert [tuple(x) for x in incremental.refused(after, incoming).collect()] == [("b", "f")]
    anchors = spark.createDataFrame([("k1", "f", None, None, None), ("k2", "gone", None, None, None), ("k3", "f", "a", "s", None), ("k4", "f", "a", "s", "b"), ("k5", "f", "dead", "s", "b")], ANCHORS)
    symbols = spark.createDataFrame([("a", "f", "s", "b", False), ("dead", "f", "s", "b", True)], "fqn string, path string, sig_hash string, body_hash string, deleted boolean")
    assert {x.fact_key: x.intact for x in states.intact_facts(anchors, symbols).collect()} == {"k1": True, "k2": False, "k3": False, "k4": True, "k5": False}
    assert states.intact_facts(anchors.limit(0), symbols).count() == 0


def test_the_ledger_needs_no_targets(spark, monkeypatch):
    edited = {k: v for k, v in BASE.items() if k != "a/Leaf.java"} | {"a/Child.java": ([("p.Child", "s", "b2", "declares")], [])}
    want = {("file", "a/Leaf.java", None, None, "deleted", None), ("file", "a/Child.java", None, None, "modified", "content"), ("symbol", "a/Child.java", "p.Child", None, "modified", "body"), ("symbol", "a/Leaf.java", "p.Leaf#value()", None, "deleted", None)}
    none = [spark.createDataFrame([], t) for t in (ANCHORS, FACTS, ALIASES)]

    def refuse(*_, **__):
        raise AssertionError("no edge is to be resolved")

    monkeypatch.setattr(rescan, "resolve", refuse)
    before, (tree, symbols, _) = tables(spark, BASE), tables(spark, edited)
    got = rescan.replaced(rescan.scan(*before, *none, linked=False), tree, symbols)
    assert {tuple(r) for r in got.changes.collect()} == want


def test_a_scan_asks_each_hint_once_and_writes_no_edge_twice(spark, monkeypatch):
    callers = {f"a/C{i}.java": ([(f"p.C{i}#run()", "s", "b", "declares")], [(f"p.C{i}#run()", "calls", j, h) for j, h in enumerate(("p.Helper#greet()", "#m", "m", None))]) for i in range(6)}
    files = callers | {"b/T.java": ([("p.T#m()", "s", "b", "declares"), ("p.T", "s", "b", "declares")], [])}
    asked, wide, hints, settled = [], [], rescan.resolve.resolve_hints, rescan.settled
    monkeypatch.setattr(rescan.resolve, "resolve_hints", lambda a, *r, **k: (asked.append(sorted(x.hint for x in a.where("hint IS NOT NULL").collect())), hints(a, *r, **k))[1])
    monkeypatch.setattr(rescan, "settled", lambda df: (wide.append({"src", "hint"} <= set(df.columns)), settled(df))[1])
    index = fresh(spark, files)
    assert asked == [["#m", "m", "p.Helper#greet()"]] and sum(wide) == 1
    # one name appears: of the other hints none is asked again, and edges that stay aren't written
    late = files | {"b/Helper.java": ([("p.Helper#greet()", "s", "b", "declares")], [])}
    del asked[:], wide[:]
    got = step(spark, index, late)
    assert asked == [["p.Helper#greet()"]] and got.report["edges_walked"] == 6 and sum(wide) <= 2
    monkeypatch.undo()
    assert rows(got.index) == rows(fresh(spark, late))
    # an index that has nothing but its edges is brought to the same, and so is one that went through a rescan
    bare = rescan.Index(index.files, index.symbols, index.edges, index.anchors, index.facts, index.aliases)
    assert rows(step(spark, bare, late).index) == rows(got.index)
    fewer = {k: v for k, v in late.items() if k != "a/C0.java"}
    third = step(spark, got.index, fewer, 3).index
    assert rows(third) == rows(fresh(spark, fewer)) and {r.hint: r.n for r in third.hints.collect()} == {"p.Helper#greet()": 5, "#m": 5, "m": 5, None: 5}
