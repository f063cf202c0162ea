"""Registered queries of the strings people see and of the kept text index."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text_index
from ..operators.settle import folder
from ..operators.ui_strings import ui_strings as extracted
from .catalog import NO_CTE, query
from .derive import read

LINES = """WITH d AS (SELECT source || '/' || doc_id AS path, doc_id, CASE WHEN doc_id % 10 = 0 THEN text || chr(10) || 'renewed edition ' || lang ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0),
l AS (SELECT DISTINCT path, i AS line, s AS text FROM (SELECT path, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
k AS (SELECT *, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS t FROM l), st AS (SELECT count(*) AS n, sum(len(t)) / count(*) AS a FROM k),
q0 AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1) AS t FROM benchmark WHERE item_id % 50 = 0), q1 AS (SELECT query_id, unnest(t) AS term, generate_subscripts(t, 1) AS i FROM q0), q2 AS (SELECT query_id, term, min(i) AS i FROM q1 GROUP BY 1, 2),
q AS (SELECT query_id, term FROM q2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY i) <= 256),
ex AS (SELECT path, line, text, len(t) AS len, unnest(t) AS term FROM k), tf AS (SELECT path, line, text, len, term, count(*) AS tf FROM ex WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
s AS (SELECT query_id, path, line, text, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY 1, 2, 3, 4)
SELECT query_id, rank::INT AS rank, path, line, text, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, path, line, text) AS rank FROM s) WHERE rank <= 10"""


@query("text_search", NO_CTE + LINES)
def text_search(spark, d):
    """Lines of documents, indexed once, then updated: a tenth gets a line more, some go. Every fiftieth benchmark item asks for its ten best lines."""
    docs = read(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), "lang", "text")
    where = folder(spark)

    def put(rows, version):
        line = rows.where("NOT deleted").select("path", F.posexplode(F.split("text", "\n")).alias("i", "text"))
        strings = line.select("path", (F.col("i") + 1).alias("line"), F.lit("line").alias("kind"), F.lit(None).cast("string").alias("locale"), "text")
        text_index.replace_files(where, strings, rows.select("path", "deleted"), version)

    put(docs.withColumn("deleted", F.lit(False)), 1)
    more = docs.where("doc_id % 10 = 0").withColumn("text", F.concat("text", F.lit("\nrenewed edition "), "lang"))
    put(more.unionByName(docs.where("doc_id % 17 = 0 AND doc_id % 10 > 0")).withColumn("deleted", F.col("doc_id") % 17 == 0), 2)
    queries = read(spark, d, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")
    return text_index.search(spark, where, queries, 10).withColumn("score", F.round("score", 4))


VISIBLE = r"octet_length(encode(t)) BETWEEN 2 AND 200 AND NOT contains(t, '/') AND NOT contains(t, chr(92)) AND NOT starts_with(t, '@') AND NOT starts_with(t, '#') AND regexp_matches(t, '\p{L}') AND (contains(t, ' ') OR regexp_matches(t, '^\p{Lu}')) AND NOT regexp_full_match(t, '[a-z0-9-]*')"


@query("ui_strings", NO_CTE + r"""WITH t AS (SELECT 'src/' || page_id || '.tsx' AS path, replace('const a = ''Page ' || page_id || ''', b = "useState", c = "px-4";' || chr(10) || '<input data-testid="t' || page_id || '" placeholder = ''Find ' || url || ''' aria-label="Go on"/> // placeholder="no"' || chr(10) || 'import x from "Some Thing"' || chr(10) || html, chr(13) || chr(10), chr(10)) AS t FROM pages WHERE html IS NOT NULL),
l AS (SELECT path, unnest(string_split(t, chr(10))) AS s, generate_subscripts(string_split(t, chr(10)), 1) AS line FROM t),
attrs AS (SELECT path, line, kind, NULL::VARCHAR AS locale, trim(regexp_extract(s, name || '[ ]*=[ ]*["'']([^"'']*)', 1)) AS text FROM l, (VALUES ('data-testid', 'test_id'), ('aria-label', 'aria_label'), ('placeholder', 'placeholder')) v(name, kind) WHERE regexp_matches(s, name || '[ ]*=[ ]*["'']') AND octet_length(encode(text)) BETWEEN 1 AND 400),
q AS (SELECT path, line, unnest(list_filter(string_split(s, m), lambda x, i: i % 2 = 0)) AS t FROM l, (VALUES ('"'), (chr(39))) v(m) WHERE NOT regexp_matches(s, '^[ \t]*(import |//|\*)')),
c AS (SELECT path, line, 'literal' AS kind, NULL::VARCHAR AS locale, t AS text FROM (SELECT path, line, trim(t, ' ' || chr(9) || chr(13)) AS t FROM q) WHERE """ + VISIBLE + r"""),
j AS (SELECT 'app/locales/' || lang || '/d' || doc_id || '.json' AS path, lang, source, source || ' ' || doc_id AS a, n_chars FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL),
js AS (SELECT path, 0::BIGINT AS line, unnest([{'kind': 'i18n_key', 'locale': NULL, 'text': 'page'}, {'kind': 'i18n_key', 'locale': NULL, 'text': 'title'}, {'kind': 'i18n_value', 'locale': lang, 'text': a}, {'kind': 'i18n_key', 'locale': NULL, 'text': 'tags'}, {'kind': 'i18n_value', 'locale': lang, 'text': source}, {'kind': 'i18n_key', 'locale': NULL, 'text': 'n'}], recursive := true) FROM j),
p AS (SELECT 'app/i18n/messages_' || lang || '.properties' AS path, lang, doc_id, source FROM documents WHERE doc_id % 4 > 0 AND lang IS NOT NULL AND source IS NOT NULL), pn AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS line FROM p),
ps AS (SELECT path, line, 'i18n_key' AS kind, NULL AS locale, 'k.' || doc_id AS text FROM pn UNION ALL SELECT path, line, 'i18n_value', lang, source || ' = x' FROM pn)
SELECT DISTINCT * FROM (SELECT * FROM c UNION ALL SELECT * FROM attrs UNION ALL SELECT path, line, kind, locale, text FROM js UNION ALL SELECT * FROM ps)""")
def ui_strings(spark, d):
    """Pages as components; a JSON file for each document and a properties file for each language."""
    docs = read(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL")
    label = F.concat("source", F.lit(" "), F.col("doc_id").cast("string"))
    nested = F.to_json(F.struct(F.struct(label.alias("title"), F.array("source", "source").alias("tags"), F.col("n_chars").alias("n")).alias("page")))
    json = docs.select(F.concat(F.lit("app/locales/"), "lang", F.lit("/d"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), nested.alias("text"))
    line = F.concat(F.lit("k."), F.col("doc_id").cast("string"), F.lit(" = "), "source", F.lit(" = x"))
    every = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", line.alias("s")))), lambda x: x["s"])
    properties = docs.where("doc_id % 4 > 0").groupBy("lang").agg(F.array_join(every, "\n").alias("text")).select(F.concat(F.lit("app/i18n/messages_"), "lang", F.lit(".properties")).alias("path"), "text")
    page = F.col("page_id").cast("string")
    head = F.concat(F.lit("const a = 'Page "), page, F.lit("', b = \"useState\", c = \"px-4\";\n<input data-testid=\"t"), page, F.lit("\" placeholder = 'Find "), "url", F.lit("' aria-label=\"Go on\"/> // placeholder=\"no\"\nimport x from \"Some Thing\"\n"))
    pages = read(spark, d, "pages").select(F.concat(F.lit("src/"), page, F.lit(".tsx")).alias("path"), F.concat(head, "html").alias("text"))
    return extracted(pages.unionByName(json).unionByName(properties))
