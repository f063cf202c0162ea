"""Intents, words that may name symbols, and seeds."""

from pyspark.sql import functions as F

from quillon.functions import words
from quillon.operators import context


def said(spark, *texts, **more):
    rows = [(i, t, *(v[i] for v in more.values())) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "request_id long, text string" + "".join(f", {k} boolean" for k in more))
    return [(r.intent, r.signal, r.confident) for r in context.classified(df).orderBy("request_id").collect()]


def test_intents(spark):
    got = said(spark, "the url prefix is odd", "review the fix for the broken parser", "Clean-up this", "is this SAFE?", "add and rename", "why\n\tat x.Y", "fix it\nException", "add a review: Exception", "add it, support: Exception in x", "  ", None, "nothing here", "how does it move")
    assert got == [("unknown", None, False), ("debug", "fix", True), ("refactor", "clean up", True), ("review", "is this safe", True), ("refactor", "rename", True), ("debug", "stack trace", True), ("debug", "fix", True), ("debug", "stack trace", True), ("build", "add", True), ("unknown", None, False), ("unknown", None, False), ("unknown", None, False), ("refactor", "move", True)]
    turns = said(spark, "now do the same for orders", "now do the same for orders", "fix that in PaymentService", "fix thatch", None, anchored=[False, False, True, False, None], carried=[True, False, True, True, None])
    assert turns == [("referential", "refers to the previous turn", True), ("unknown", None, False), ("debug", "fix", True), ("debug", "fix", True), ("unknown", None, False)]
    assert said(spark) == []


def test_targets(spark):
    texts = ["After the reset_after, call `Engine::context(x)`; see a/b.ts. (idempotency) _private_ data it", "", None, "ab a.b xY über_x Über überall. getIt? x::y::z"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = [r.w for r in df.select("i", words.targets(F.col("t")).alias("w")).orderBy("i").collect()]
    assert got == [sorted(["reset_after", "`Engine::context", "`Engine#context", "a/b.ts", "idempotency", "_private_"]), [], None, sorted(["a.b", "über_x", "Über", "überall", "getIt", "x::y::z", "x::y#z"])]


def test_seeds(spark):
    rows = [("p.Order", "class", "p/Order.java", 1, False), ("p.Order#total()", "method", "p/Order.java", 5, False), ("p.Order#gone()", "method", "p/Order.java", 6, True), ("p.Ordering#x()", "method", "p/O.java", 1, False), ("q.Repo#findByIdempotencyKey(a)", "method", "q/R.java", 3, False), ("q.Repo#idempotencyKey()", "method", "q/R.java", 2, False), ("q.Late#resolved()", "method", "q/L.java", 2, False), ("q.report::Resolved", "struct", "q/L.java", 9, False), ("a.T#handler()", "method", "a/T.java", 1, False), ("b.T#handler()", "method", "b/T.java", 1, False), ("graphql:svc/x:Query.go", "route", "svc/x/s", 1, False)]
    rows += [(f"w.W{i}#payment{chr(65 + i)}x()", "method", "w/W.java", i, False) for i in range(7)] + [(f"w.W#unitary{i}()", "method", "w/U.java", i, False) for i in range(210)] + [("w.W#unit()", "method", "w/U.java", 0, False), ("w.W#getUnita()", "method", "w/U.java", 0, False)]
    symbols = spark.createDataFrame(rows, "fqn string, kind string, file_path string, start_line int, deleted boolean")
    texts = ["the idempotency key", "was it resolved", "handler of payment", "see p.Order", "p/Order.java", "unit", "unita", "graphql:Query.go and #total", "orders of nothing", None]
    got = {}
    for r in context.seeds(spark.createDataFrame(list(enumerate(texts)), "request_id long, text string"), symbols).collect():
        got.setdefault(r.request_id, set()).add((r.fqn, r.source, r.strength))
    exact, name = context.SOURCES.index("exact"), context.SOURCES.index("name match")
    assert got == {
        0: {("q.Repo#findByIdempotencyKey(a)", name, 0), ("q.Repo#idempotencyKey()", name, 0)},
        1: {("q.Late#resolved()", name, 1)},
        3: {("p.Order", exact, 2), ("p.Order#total()", exact, 2)},
        4: {("p.Order", exact, 2), ("p.Order#total()", exact, 2)},
        5: {("w.W#unit()", name, 1)},
        7: {("graphql:svc/x:Query.go", exact, 2), ("p.Order#total()", exact, 2)},
    }
    offered = spark.createDataFrame([(2, "p.Order", 0, 25), (2, "T#handler()", 6, 1)], "request_id long, target string, source int, most int")
    more = {(r.fqn, r.source) for r in context.seeds(spark.createDataFrame([(2, "handler")], "request_id long, text string"), symbols, offered).collect()}
    assert more == {("p.Order", 0), ("p.Order#total()", 0), ("a.T#handler()", 6)}
    many = "x.Y" + " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)) + " zzz.Order p.Order"
    assert {r.fqn for r in context.seeds(spark.createDataFrame([(1, many)], "request_id long, text string"), symbols).collect()} == {"p.Order", "p.Order#total()"}
    assert context.seeds(spark.createDataFrame([], "request_id long, text string"), symbols).count() == 0
    assert context.seeds(spark.createDataFrame([(1, "p.Order")], "request_id long, text string"), symbols.where("false")).count() == 0
