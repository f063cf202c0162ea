"""Filter audit, exact top k and conversation repair against plain versions, SQL and edge cases."""

import glob
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import conversations, filter_audit, max_score, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_max_score", "op13_conversation_repair"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = registry.queries()[name](spark, SF)
    c = con.execute(registry.oracle_sql()[name])
    columns = [x[0] for x in c.description]
    assert df.columns == columns
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, c.fetchall()))


# 11


def plain_audit(rows, labels):
    """Rows (id, text, source); labels (id, quality, toxic)."""
    fails, marks = [], []
    for i, t, _ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        e = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)
        fails.append({"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": e})
        marks.append(tuple(any(x[0] == i and x[0] is not None and x[k] == 1 for x in labels) for k in (1, 2)))
    out, shapley = {}, {}
    parts = [s or "" for _, _, s in rows]
    for part in set(parts):
        own = [(f, m) for f, m, p in zip(fails, marks, parts, strict=True) if p == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if x[0][c]]
                left = [x for x in left if not x[0][c]]
                before = sum(x[0][c] for x in own) - len(gone)
                alone = sum(x[0][c] and sum(x[0].values()) == 1 for x in own)
                out[part, order, step] = (len(left), len(gone), before, alone, sum(x[1][0] for x in gone), sum(x[1][1] for x in gone))
                shapley[part, c] = shapley.get((part, c), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_equals_plain(spark):
    r = random.Random(5)
    words = ["alpha", "Beta", "GAMMA", "d$", "é|", " ", "x", "#"]
    rows = []
    for i in range(300):
        t = r.choice([None, "", " \t\n", "A" * 5000 + " b" * 60, "same text " * 40, "café " * 60, None]) if r.random() < 0.4 else " ".join(r.choice(words) + str(r.randrange(200)) * r.randrange(2) for _ in range(r.randrange(90)))
        rows.append((None if i % 50 == 49 else i // 2 if i % 7 == 0 else i, t, r.choice([None, "", "s1", "s2", "ß"])))
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("bits", F.lit(7)).withColumn("part", F.lit("z")).withColumn("digest", F.lit(1)).repartition(5)
    got = filter_audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert {tuple(x[:3]): tuple(x[3:]) for x in got} == plain_audit(rows, labels) and len(got) == 600 * 4


def test_audit_without_rows_and_with_many_parts(spark, monkeypatch):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(spark.createDataFrame([], "doc_id long, text string, source string"), labels).collect() == []
    monkeypatch.setattr(filter_audit, "PARTS", 3)
    docs = spark.createDataFrame([(i, "x $", f"s{i % 11}") for i in range(100)], "doc_id long, text string, source string").coalesce(1)
    got = filter_audit.survivors(filter_audit.flagged(docs, labels)).collect()
    assert len(got) == 11 and sum(x.kept[0] for x in got) == 100 and sum(x.kept[31] for x in got) == 0 and sum(x.good[0] for x in got) == 0


# 12


def plain_top(queries, rows, k):
    out = []
    for i, q in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in rows if j != i)[:k]
        out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored, 1)]
    return sorted(out)


@pytest.mark.parametrize("low, high", [(-5, 5), (-9, 0), (0, 3), (-1000, 1000)])
def test_top_k_equals_plain(spark, low, high, monkeypatch):
    monkeypatch.setattr(max_score, "STRETCH", 16)  # of the lists asked directly, below
    r = random.Random(low)
    rows = [(r.randrange(400), [r.randint(low, high) for _ in range(r.choice([6, 6, 6, 0, 3]))]) for _ in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    queries = {}
    for i, v in rows:
        if i % 5 == 0:
            queries[i] = min(queries.get(i, v), v)
    v = spark.createDataFrame([*rows, (None, [1]), (7, None)], "id long, v array<long>").repartition(3)
    got = max_score.top_k(v.where("id % 5 = 0"), v, 10, shard=64, block=9).collect()
    assert sorted(tuple(x) for x in got) == plain_top(queries, rows, 10)
    ids, values = np.array([i for i, _ in rows]), np.array([v + [0] * (6 - len(v)) for _, v in rows])
    lists = max_score.Postings(ids, values)
    for i, q in queries.items():
        scores, found = lists.best(i, np.array(q + [0] * (6 - len(q))), 10)
        assert [(i, n, j, s) for n, (j, s) in enumerate(zip(found.tolist(), scores.tolist(), strict=True), 1)] == plain_top({i: q}, rows, 10)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [0.5, -0.25]), (100, [1.0, 1.0]), (1, [float("nan"), 1.0]), (2, [1.0, None]), (3, None), (4, [float("inf"), 0.0]), (5, [-0.0001, 0.0]), (6, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = sorted(tuple(x) for x in max_score.nearest(v).collect())
    assert got == [(0, 1, 100, 512 * 1024 - 256 * 1024), (0, 2, 6, 0), (0, 3, 5, -512), (100, 1, 0, 256 * 1024), (100, 2, 6, 0), (100, 3, 5, -1024)]
    assert max_score.nearest(v.where("false")).collect() == [] and max_score.nearest(v.where("vec_id = 1")).collect() == []
    with pytest.raises(Exception, match="63 bits"):
        max_score.nearest(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>")).collect()


# 13


def plain_repair(rows):
    """Every edit of every row, with up to two inserts anywhere: the least (cost, audit) and what is left. Rows: (role, text)."""
    space = "\x20\t\n\v\f\r"
    faults, seen = [], set()
    for role, text in rows:
        end = text.rstrip(space)
        faults.append("b" if not end else "d" if (role, text) in seen else "" if end[-1] in ".!?" else "t")
        seen.add((role, text))
    inserts = [[("I", 3, r, "") for r in x] for x in ((), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user"))]
    edits = []
    for (role, text), fault in zip(rows, faults, strict=True):
        edits.append(inserts)
        more = 3 if fault == "t" else 0
        edits.append([[("D", 4, None, None)]] + ([[("K", more, role, text)], [("R", 3 + more, "user", text)], [("R", 3 + more, "assistant", text)]] if fault not in ("b", "d") else []))
    edits.append(inserts)
    best = None
    for choice in itertools.product(*edits):
        flat = [x for part in choice for x in part]
        kept = [(r, t) for _, _, r, t in flat if r is not None]
        if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in kept)):
            one = (sum(x[1] for x in flat), "".join(x[0] for x in flat), "\n".join(f"{r}:{t}" for r, t in kept))
            best = min(best, one) if best else one
    return faults, best


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))


@pytest.mark.parametrize("turns", [1, 256])
def test_repair_equals_plain(spark, turns, monkeypatch):
    monkeypatch.setattr(conversations, "TURNS", turns)
    r = random.Random(turns)
    texts = ["Hi.", "So what", "", None, " \t", "Yes!  \n", "no ", "a\nb?"]
    rows = []
    for conv in [None, *range(60)]:
        for _ in range(r.randrange(4)):
            rows.append((conv, r.choice([None, 0, 1, 2, 3, 300, -5]), r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(texts)))
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("state", F.lit(1)).repartition(3)
    got = {x.conv_id: x for x in conversations.repair_report(t).collect()}
    assert set(got) == {x[0] for x in rows}
    for conv, x in got.items():
        own = plain_damage([y for y in rows if y[0] == conv])
        if len(own) > 4:
            continue
        faults, (cost, audit, text) = plain_repair([y[1:] for y in own])
        known = {y[0] for y in own} - {None}
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        assert (x.cost, x.audit) == (cost, audit), (own, x)
        assert (x.blank, x.duplicate, x.truncated, x.illegal) == (*map(faults.count, "bdt"), sum(p not in ("su", "ua", "au") for p in pairs))
        assert x.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)
        assert x.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_repair_of_nothing_and_of_a_long_conversation(spark, monkeypatch):
    schema = "conv_id long, turn long, role string, text string"
    assert conversations.repair_report(spark.createDataFrame([], schema)).collect() == []
    r = random.Random(2)
    rows = [(1, i, r.choice(["user", "assistant", "system", "x"]), r.choice(["So.", "Ok!", "what", f"{i}."])) for i in range(2000)]
    t = spark.createDataFrame(rows, schema)
    whole = conversations.repair_report(t).collect()
    monkeypatch.setattr(conversations, "TURNS", 7)
    assert conversations.repair_report(t).collect() == whole
    layer = conversations.closed([(0, ""), None, None, None])
    seen = set()
    for _, role, text in plain_damage(rows):
        layer = conversations.passed(layer, role[:1], conversations.fault_of(role, text, (role, text) in seen))
        seen.add((role, text))
    assert (whole[0].cost, whole[0].audit) == min(x for s, x in enumerate(layer) if s in conversations.ENDS and x)
