"""The corpus pipeline stage by stage against plain versions, with nulls, repeats, extra columns and empty tables."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
P = pytest.importorskip("corpus_pipeline")

from quillon.llm import mixing, pii, quality  # noqa: E402

from test_llm import base_personal, plain_components  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __m string, row long, c0 int"


def rows(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    out = []
    for i in range(60):
        words = [word() for _ in range(r.randrange(12, 90))]
        if i % 6 == 0:
            words[3:3] = ["mail", f"joe{i}@mail.example.org", "or", "10.0.0." + str(i)]
        out.append(" ".join(words))
        if i % 5 == 0:
            out.append(" ".join([*words[:-1], "other"]))
        if i % 20 == 0:
            out.append(out[-1])
    out += [None, "", "too short", "same again and again " * 12, "word ### " * 40]
    data = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t) if t else None, "x", i, 1) for i, t in enumerate(out)]
    return [*data, data[0], data[0], (None, data[4][1], "en", "a", 3, None, None, None)]


def key(values):
    return Counter(map(str, values))


def test_quality_stage(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    kept = P.keep_good(spark, docs, "")
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    plain = quality.quality(docs.drop("__m"), ["doc_id", "lang", "source"]).where("__kept").select("doc_id").collect()
    assert key(x.doc_id for x in kept.select("doc_id").collect()) == key(x.doc_id for x in plain)
    texts = {x.text for x in kept.select("text").collect()}
    assert not texts & {None, "", "too short", "same again and again " * 12} and len(texts) > 50


def test_near_duplicates_stage(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    kept = P.keep_one(spark, docs, "")
    parts = plain_components([x[1] for x in data], 5, 80)
    groups = {}
    for (i, n, c), x in zip(parts, data, strict=True):
        groups.setdefault(("empty", i) if not n else c, []).append(x)
    # of each group the smallest id (a null counts as the largest), once; empty texts all stay
    best = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in groups.values()]
    assert kept.columns == docs.columns and key(tuple(x) for x in kept.collect()) == key(best)


def test_pii_stage(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    spans = {x.row: [(y.kind, y.start, y.end) for y in x.spans] for x in pii.personal_spans(docs.where("row IS NOT NULL"), keep=["row"]).collect()}
    got = {x["row"]: x for x in P.redact(spark, docs, "").where("row IS NOT NULL").collect()}
    seen = 0
    for _, t, _, _, n, _, i, _ in data:
        if i is None:
            continue
        assert [x for x in spans[i] if x[0] in pii.BASE] == base_personal(t)
        plain, at = "", 0
        for s, e, kind in sorted((s, e, k) for k, s, e in spans[i]):
            if s >= at:
                plain += t[at:s] + f"<{kind.upper()}>"
            at = max(at, e)
        want = plain + t[at:] if spans[i] else t
        seen += bool(spans[i])
        assert got[i].text == want and got[i].n_chars == (len(want) if spans[i] else n)
    assert seen >= 10


def test_mixing_stage(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    got = key(tuple(x) for x in P.mix_sources(spark, docs, "").collect())
    again = key(tuple(x) for x in P.mix_sources(spark, docs.repartition(5), "").collect())
    assert got == again and set(got) <= set(map(str, data))
    taken = {x.doc_id: x.taken // x["size"] for x in mixing.report(docs).collect() if x["size"] and x.doc_id not in (0, None)}
    assert all(got.get(str(x), 0) == taken.get(x[0], 0) for x in data if x[0] not in (0, None))


def test_sentencepiece_stage(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    data = rows()
    got = P.encode(spark, spark.createDataFrame(data, SCHEMA), "").collect()
    assert key((x.doc_id, x.lang, x.source, list(x.ids), x.decodes_back) for x in got) == key((x[0], x[2], x[3], library.encode(x[1] or ""), True) for x in data)


def test_stages_of_an_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, none, "")
        assert out.count() == 0 and out.columns == none.columns
    assert P.encode(spark, none, "").count() == 0


def test_run_applies_the_stages(spark, tmp_path):
    docs = spark.createDataFrame([x[:5] for x in rows()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    step = docs
    for _, stage in P.STAGES:
        step = stage(spark, step, str(tmp_path))
    got = P.run(spark, str(tmp_path))
    assert got.columns == step.columns and key(tuple(x) for x in got.collect()) == key(tuple(x) for x in step.collect()) and got.where(~F.col("decodes_back")).count() == 0
