"""The kept text index and the strings that people see."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import screen
from quillon.operators import text_index
from quillon.operators.settle import folder
from quillon.operators.ui_strings import json_strings, ui_strings

STRINGS = "path string, line long, kind string, locale string, text string"


def put(spark, where, rows, version, gone=()):
    strings = spark.createDataFrame([(p, i, "literal", None, t) for p, i, t in rows], STRINGS)
    files = spark.createDataFrame([(p, False) for p in {r[0] for r in rows}] + [(p, True) for p in gone], "path string, deleted boolean")
    text_index.replace_files(where, strings, files, version)


def ask(spark, where, *queries, limit=20):
    q = spark.createDataFrame(list(enumerate(queries)), "query_id long, text string")
    return [(r.query_id, r.path, r.line, r.text) for r in text_index.search(spark, where, q, limit).orderBy("query_id", "rank").collect()]


def test_index_follows_its_files(spark):
    where = folder(spark)
    first = [("a", 1, "Confirm the order"), ("a", 2, "Order, order!"), ("b", 1, "Батлах товч"), ("b", 2, None), ("b", 3, "..."), ("b", 1, "Батлах товч")]
    put(spark, where, first + [("x", i, f"filler {i} words") for i in range(20)], 1)
    assert [x[1:3] for x in ask(spark, where, "ORDER?")] == [("a", 2), ("a", 1)]
    assert ask(spark, where, "батлах", "", "a", "nothing", None) == [(0, "b", 1, "Батлах товч")]
    put(spark, where, [("a", 7, "confirmed")], 2, gone=["x"])
    assert ask(spark, where, "order", "confirmed", "filler") == [(1, "a", 7, "confirmed")]
    put(spark, where, [("a", 7, "confirmed")], 2, gone=["x"])  # run again
    assert len(ask(spark, where, "confirmed")) == 1
    # an update writes its own files' postings alone
    own = spark.read.parquet(f"{where}/postings/version=2")
    assert {r.path for r in own.collect()} == {"a"}
    new = folder(spark)
    text_index.compacted(spark, where, new)
    assert ask(spark, new, "confirmed") == ask(spark, where, "confirmed") and spark.read.parquet(f"{new}/files").count() == 2


def test_search_reads_its_terms_buckets_only_and_equals_a_scan(spark):
    where = folder(spark)
    words = ["red", "green", "blue", "sky", "sea", "sun"]
    rows = [(f"p{i % 7}", i, " ".join(words[(i * k) % 6] for k in range(1, 2 + i % 5))) for i in range(90)]
    put(spark, where, rows, 1)
    asked = text_index.query_terms(spark.createDataFrame([(1, "sea Sun sea")], "query_id long, text string"))
    plan = text_index.postings_of(spark, where, asked)._jdf.queryExecution().executedPlan().toString()
    buckets = {r.bucket for r in asked.collect()}
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0] and len(buckets) == 2
    import math

    n, docs = len(rows), [(p, i, t, t.split()) for p, i, t in rows]
    avg = sum(len(t) for *_, t in docs) / n
    score = {}
    for term in ("sea", "sun"):
        df = sum(term in t for *_, t in docs)
        for p, i, text, t in docs:
            if tf := t.count(term):
                score[p, i, text] = score.get((p, i, text), 0) + max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    want = sorted(score, key=lambda k: (-round(score[k], 6), *k))[:20]
    assert [x[1:] for x in ask(spark, where, "sea Sun sea")] == want
    long = " ".join(f"w{i}" for i in range(300)) + " sea"
    assert ask(spark, where, long) == []  # beyond the first 256 different terms


def test_index_writes_little_and_finds_strings_that_share_a_line(spark):
    where = folder(spark)
    rows = [("a", 1, "literal", "mn", "one sun"), ("a", 1, "literal", None, "one sun"), ("a", 1, None, "literal", "one sun"), ("a", 1, "literal", None, "one sun"), ("a", None, "literal", None, "sun sun"), ("a", 2, "literal", None, "moon"), ("b", -3, "literal", None, "two suns"), ("b", 1, "literal", None, "sun"), ("gone", 1, "literal", None, "sun"), ("other", 1, "literal", None, "sun"), (None, 1, "literal", None, "sun")]
    files = spark.createDataFrame([("a", False), ("b", False), ("gone", True)], "path string, deleted boolean")
    text_index.replace_files(where, spark.createDataFrame(rows, STRINGS), files, 1)
    own = spark.read.schema(text_index.STRINGS).parquet(f"{where}/strings/version=1")
    ids = {(r.path, r.line, r.kind, r.locale, r.text): r.id for r in own.collect()}
    assert len(ids) == own.count() == 7 and len({(k[0], i) for k, i in ids.items()}) == 7
    assert ids["a", 2, "literal", None, "moon"] == 2 and all(i < 0 for k, i in ids.items() if k[1] != 2 and k[:2] != ("b", 1))
    assert {r.path for r in spark.read.parquet(f"{where}/postings/version=1").collect()} == {"a", "b"}
    queries = spark.createDataFrame([(1, "sun")], "query_id long, text string")
    got = text_index.search(spark, where, queries, 10)
    assert sorted((r.path, str(r.line), r.text) for r in got.collect()) == [("a", "1", "one sun")] * 3 + [("a", "None", "sun sun"), ("b", "1", "sun")]
    # neither the texts of files nor the words of lines are exchanged; a posting is as small as its line's number
    many = folder(spark)
    lines = spark.range(3000).select(F.concat(F.lit("f"), (F.col("id") % 300).cast("string")).alias("path"), F.floor(F.col("id") / 300).alias("line"), F.lit("line").alias("kind"), F.lit(None).cast("string").alias("locale"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.xxhash64("id", i) % 2000).cast("string"))), " ").alias("text"))
    text_index.replace_files(many, lines, lines.select("path", F.lit(False).alias("deleted")), 1)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{many}/postings").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getContentSummary(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{many}/postings")).getLength()
    assert size < 9 * spark.read.parquet(f"{many}/postings").count(), size


def test_terms_of_a_very_long_line_are_counted_in_its_row(spark):
    n = 200_000
    words = spark.range(0, 2, 1, 1).select("id", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("w"), (i * (F.col("id") + 1) % 1000).cast("string"))).alias("words")).union(spark.sql("SELECT 9L, array('b', 'a', 'b')")).union(spark.sql("SELECT 10L, cast(array() AS array<string>)"))
    counts = text_index.counted(words)
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
    got = {(r.id, r.term): r.tf for r in counts.collect()}
    assert len(got) == 1000 + 500 + 2 and got[9, "b"] == 2 and got[9, "a"] == 1
    assert all(v == n // 1000 for k, v in got.items() if k[0] == 0) and all(v == n // 500 for k, v in got.items() if k[0] == 1)


def test_screen_functions(spark):
    paths = {"src/locales/mn/common.json": "mn", "i18n/messages_mn.properties": "mn", "lang/en.json": "en", "a/messages.json": None, "locale/en-GB/x.json": "en-gb", "messages_zz9.json": None}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.l for r in df.select("p", screen.locale_of(F.col("p")).alias("l")).collect()} == paths
    yes = ["Confirm", "Are you sure?", "Ünder", "log in"]
    no = ["useState", "px-4", "@scope", "a/b c", "#fff Fff", "x", "A" * 201, "123 456", "don't", "C:\\Dir"]
    got = {r.s for r in spark.createDataFrame([(x,) for x in yes + no], "s string").where(screen.looks_visible(F.col("s"))).collect()}
    assert got == set(yes)
    files = ["a/B.TSX", "x/node_modules/a.tsx", "src/i18n/x.json", "x.json", "a.vue", "messages.properties", "src/build/a.vue"]
    kept = {r.p for r in spark.createDataFrame([(x,) for x in files], "p string").where(screen.is_candidate(F.col("p"))).collect()}
    assert kept == {"a/B.TSX", "src/i18n/x.json", "a.vue", "messages.properties"}


def test_strings_of_files(spark):
    tsx = 'import a from "Some Name"\n// "Not This"\n<b aria-label=\'Close it\' placeholder = "Find" data-testid=x>"Save me" \'Two Words\'</b>\r\nconst s = "Open end\n\n'
    json = '{"cart": {"confirm": "Батлах", "n": 1, "list": ["Нэг", {"deep": {"er": "x"}}]}, "e": "", "long": "' + "y" * 401 + '"}'
    files = [("a.tsx", tsx), ("locales/mn.json", json), ("src/locales/mn/c.json", json), ("i18n/bad.json", "{"), ("src/i18n/en.json", "{no"), ("src/lang/p_en.properties", "# c\n! d\nkey = a = b\n\nnothing\n"), ("z.tsx", None), ("q.txt", '"Save me"')]
    got = {(r.path, r.line, r.kind, r.locale, r.text) for r in ui_strings(spark.createDataFrame(files, "path string, text string")).collect()}
    assert {x[1:] for x in got if x[0] == "a.tsx"} == {(3, "aria_label", None, "Close it"), (3, "placeholder", None, "Find"), (3, "literal", None, "Save me"), (3, "literal", None, "Close it"), (3, "literal", None, "Find"), (3, "literal", None, "Two Words"), (4, "literal", None, "Open end")}
    values = {(k, loc, t) for p, _, k, loc, t in got if p == "src/locales/mn/c.json"}
    assert values == {("i18n_key", None, k) for k in ("cart", "confirm", "n", "list", "deep", "er", "e", "long")} | {("i18n_value", "mn", v) for v in ("Батлах", "Нэг", "x")}
    assert {x[1:] for x in got if x[0] == "src/lang/p_en.properties"} == {(3, "i18n_key", None, "key"), (3, "i18n_value", "en", "a = b")}
    assert {x[0] for x in got} == {"a.tsx", "src/locales/mn/c.json", "src/lang/p_en.properties"}
    assert ui_strings(spark.createDataFrame([], "path string, text string")).count() == 0
    with pytest.raises(ValueError, match="deeper"):
        json_strings(spark.createDataFrame([("src/i18n/x.json", "[" * 70 + "]" * 70)], "path string, text string"))
