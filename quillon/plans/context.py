"""Registered queries from requests in words to intents and seeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import words as W
from ..operators import context
from . import derive
from .catalog import LIVE, NO_CTE, query
from .derive import read

SAID = ("now do the same: ", "fix the broken ", "review and clean up ", "why does it add ", "is this safe? ", "move, rename; implement ", "Exception\n\tat x ", "", "prefix ")
DICTIONARY = "d(i, intent, k, phrase) AS (VALUES " + ", ".join(f"({i}, '{intent}', {k}, '{p}')" for i, (intent, phrases) in enumerate(context.INTENTS.items()) for k, p in enumerate(phrases)) + ")"


@query("intents", NO_CTE + "WITH " + DICTIONARY + ", r AS (SELECT doc_id AS request_id, [" + ", ".join("'" + s.replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for s in SAID) + """][(doc_id % 9 + 1)::INT] || text AS text, doc_id % 4 = 0 AS anchored, doc_id % 3 = 0 AS carried FROM documents),
w AS (SELECT *, ' ' || array_to_string(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''), ' ') || ' ' AS line, lower(text) AS low FROM r),
h AS (SELECT request_id, i, intent, count(*) AS n, arg_min(phrase, k) AS signal FROM w JOIN d ON contains(line, ' ' || phrase || ' ') GROUP BY 1, 2, 3), b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY n DESC, i) = 1),
x AS (SELECT w.*, b.intent AS bi, b.signal AS bs, b.n, (contains(low, chr(10) || chr(9) || 'at ') OR contains(low, chr(10) || '    at ') OR contains(low, 'traceback (most recent call last)') OR contains(low, 'exception') OR contains(low, 'panicked at')) AND (b.intent IS NULL OR (b.intent <> 'debug' AND b.n < 2)) AS trace,
 NOT anchored AND (""" + " OR ".join(f"contains(line, ' {p} ')" for p in context.REFERENTIAL) + """) AS back FROM w LEFT JOIN b ON b.request_id = w.request_id),
o AS (SELECT request_id, CASE WHEN back AND carried THEN 'referential' WHEN back THEN 'unknown' WHEN trace THEN 'debug' ELSE coalesce(bi, 'unknown') END AS intent, CASE WHEN back AND carried THEN 'refers to the previous turn' WHEN back THEN NULL WHEN trace THEN 'stack trace' ELSE bs END AS signal FROM x)
SELECT *, intent <> 'unknown' AS confident FROM o""")
def intents(spark, d):
    """Documents as requests, each behind one of nine beginnings; some name code, some follow a turn that left seeds."""
    i = F.col("doc_id")
    said = F.element_at(F.array(*map(F.lit, SAID)), (i % 9 + 1).cast("int"))
    return context.classified(read(spark, d, "documents").select(i.alias("request_id"), F.concat(said, "text").alias("text"), (i % 4 == 0).alias("anchored"), (i % 3 == 0).alias("carried")))


TEXT = """CASE s_suppkey % 7 WHEN 0 THEN 'why does customer_' || s_suppkey || ' fail?' WHEN 1 THEN 'see geo.ASIA.NATION_' || (s_suppkey % 25) || '#supplier_' || s_suppkey || ', (part_' || s_suppkey || ')' WHEN 2 THEN 'the Europe desk and america' WHEN 3 THEN 'orders of ASIA; nation' WHEN 4 THEN 'open geo/ASIA/NATION_2.java and NATION_' || (s_suppkey % 25) || '!' WHEN 5 THEN 'supplier customer order_' || s_suppkey ELSE 'africa::nation_' || s_suppkey END"""
NOISE = "(octet_length(encode(w)) < 4 OR lower(w) IN (" + ", ".join(f"'{w}'" for w in W.STOPWORDS) + "))"
CODE = "(regexp_matches(w, '[./#]|::') OR contains(trim(w, '_'), '_') OR regexp_matches(w, '^.+\\p{Lu}'))"


@query("word_targets", NO_CTE + f"""WITH s AS (SELECT doc_id, rtrim(unnest(regexp_split_to_array(text, '[\\s,;"''()]')), '.?!:') AS w FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text || ' a::b::cMe _x_ two_words p.Q#m' ELSE text END AS text FROM documents)), k AS (SELECT DISTINCT doc_id, w, {CODE} AS code FROM s WHERE octet_length(encode(w)) > 2 AND ({CODE} OR NOT {NOISE})),
a AS (SELECT * FROM k UNION SELECT doc_id, regexp_replace(w, '^(.*)::', '\\1#'), true FROM k WHERE contains(w, '::')) SELECT doc_id, count(*) AS n, count_if(code) AS code, sha256(string_agg(w, chr(10) ORDER BY w)) AS digest FROM a GROUP BY doc_id""")
def word_targets(spark, d):
    """The words of each document that may name a symbol."""
    text = F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit(" a::b::cMe _x_ two_words p.Q#m"))).otherwise(F.col("text"))
    t = read(spark, d, "documents").select("doc_id", W.targets(text).alias("t")).where(F.size("t") > 0)
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.filter("t", W.looks_like_code)).cast("long").alias("code"), F.sha2(F.array_join("t", "\n"), 256).alias("digest"))


@query("request_seeds", LIVE + f""", r AS (SELECT s_suppkey AS request_id, {TEXT} AS text FROM supplier), s0 AS (SELECT request_id, rtrim(unnest(regexp_split_to_array(text, '[\\s,;"''()]')), '.?!:') AS w FROM r), k AS (SELECT DISTINCT request_id, w, {CODE} AS code FROM s0 WHERE octet_length(encode(w)) > 2 AND ({CODE} OR NOT {NOISE})),
t AS (SELECT * FROM k UNION SELECT request_id, regexp_replace(w, '^(.*)::', '\\1#'), true FROM k WHERE contains(w, '::')), cw AS (SELECT DISTINCT w FROM t WHERE code), pw AS (SELECT DISTINCT w FROM t WHERE NOT code),
hit AS (SELECT w, fqn, row_number() OVER (PARTITION BY w ORDER BY CASE WHEN contains(w, '/') THEN start_line ELSE length(fqn) END, fqn) AS n FROM cw JOIN live ON CASE WHEN contains(w, '/') OR ends_with(w, '.java') OR ends_with(w, '.ts') THEN file_path = w ELSE ends_with(lower(fqn), lower(w)) OR contains(lower(fqn), lower(w) || '(') OR name = w END),
ex AS (SELECT w, count(*) AS n, min(fqn) AS fqn FROM pw JOIN live ON name = w GROUP BY 1), fam AS (SELECT w, fqn, count(*) OVER (PARTITION BY w) AS n FROM pw JOIN live ON list_contains(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lower(w)) WHERE w NOT IN (SELECT w FROM ex)),
big AS (SELECT w FROM pw JOIN live ON contains(lower(name), lower(w)) GROUP BY 1 HAVING count(*) >= 200),
f AS (SELECT request_id, fqn, CASE WHEN regexp_matches(w, '[./#]') THEN 1 ELSE 3 END AS source, 2 AS strength FROM t JOIN hit USING (w) WHERE n <= 10 UNION ALL SELECT request_id, fqn, 3, 1 FROM t JOIN ex USING (w) WHERE n = 1 UNION ALL SELECT request_id, fqn, 3, 0 FROM t JOIN fam USING (w) WHERE n <= 6 AND w NOT IN (SELECT w FROM big)),
m AS (SELECT request_id, fqn, min(source) AS source, max(strength) AS strength FROM f GROUP BY 1, 2), c AS (SELECT m.* FROM m JOIN live USING (fqn) WHERE kind IN ('class', 'package')),
mem1 AS (SELECT h.fqn AS holder, live.fqn, row_number() OVER (PARTITION BY h.fqn ORDER BY live.start_line, live.fqn) AS n FROM (SELECT DISTINCT fqn FROM c) h JOIN live ON starts_with(live.fqn, h.fqn || '#') OR starts_with(live.fqn, h.fqn || '.') OR starts_with(live.fqn, h.fqn || '::')),
e AS (SELECT * FROM m UNION ALL SELECT request_id, mem1.fqn, source, strength FROM c JOIN mem1 ON holder = c.fqn WHERE n <= 100) SELECT request_id, fqn, min(source)::INT AS source, max(strength)::INT AS strength FROM e GROUP BY 1, 2""")
def request_seeds(spark, d):
    """Suppliers' requests, in seven ways to name symbols: by names, paths, endings, words that are names, parts of names, and themes."""
    k = F.col("s_suppkey")
    s, m = k.cast("string"), (k % 25).cast("string")
    text = F.when(k % 7 == 0, F.concat(F.lit("why does customer_"), s, F.lit(" fail?"))).when(k % 7 == 1, F.concat(F.lit("see geo.ASIA.NATION_"), m, F.lit("#supplier_"), s, F.lit(", (part_"), s, F.lit(")"))).when(k % 7 == 2, "the Europe desk and america").when(k % 7 == 3, "orders of ASIA; nation")
    text = text.when(k % 7 == 4, F.concat(F.lit("open geo/ASIA/NATION_2.java and NATION_"), m, F.lit("!"))).when(k % 7 == 5, F.concat(F.lit("supplier customer order_"), s)).otherwise(F.concat(F.lit("africa::nation_"), s))
    return context.seeds(read(spark, d, "supplier").select(k.alias("request_id"), text.alias("text")), derive.symbols(spark, d))
