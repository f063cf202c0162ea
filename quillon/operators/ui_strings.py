"""Strings that people see, from the files that hold them: literals and attributes of components, keys and values of translations.

Files: ``path, text``. A component gives, line by line, the first ``data-testid``, ``aria-label`` and ``placeholder`` and the quoted
runs that look like phrases; a properties file its keys and values by line; a JSON file the keys of its objects and its
string values, at any depth, without lines. The JSON is taken apart one level a step, and the loop ends with the deepest.

Edge cases: other files, null texts and JSON that can't be read give nothing; strings are trimmed, and those left empty or of more than 400 bytes
go; a string counts once for each kind, language and line of a file; a line ends at LF or CR LF; a quote without its end runs to the line's end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.screen import ATTRIBUTES, is_candidate, is_translation, locale_of, looks_visible, trimmed
from .settle import released, sized

LONGEST, DEEPEST = 400, 64
KINDS = ("i18n_key", "i18n_value")


def _lines(files: DataFrame) -> DataFrame:
    split = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    return files.select("path", F.posexplode(split).alias("i", "s")).select("path", (F.col("i") + 1).cast("long").alias("line"), "s")


def component_strings(files: DataFrame) -> DataFrame:
    """``path, line, kind, locale, text`` of components, not yet trimmed."""
    found = []
    for name, kind in ATTRIBUTES.items():
        # what follows the first place of the name, and no later one
        rest = F.expr(f"substr(s, instr(s, '{name}') + {len(name)})")
        value = F.regexp_extract(rest, r"""^\s*=\s*(?:"([^"]*)|'([^']*))""", 1)
        single = F.regexp_extract(rest, r"""^\s*=\s*(?:"([^"]*)|'([^']*))""", 2)
        found.append(F.when(F.col("s").contains(name) & rest.rlike(r"""^\s*=\s*["']"""), F.struct(F.lit(kind).alias("kind"), F.concat(value, single).alias("text"))))
    left = F.ltrim(F.translate("s", "\t", " "))
    skipped = left.startswith("import ") | left.startswith("//") | left.startswith("*")

    def quoted(q: str) -> Column:
        runs = F.filter(F.split("s", q), lambda x, i: (i % 2 == 1) & looks_visible(x))
        return F.when(skipped, F.array().cast("array<struct<kind: string, text: string>>")).otherwise(F.transform(runs, lambda x: F.struct(F.lit("literal").alias("kind"), x.alias("text"))))

    every = F.concat(F.array_compact(F.array(*found)), quoted('"'), quoted("'"))
    return _lines(files).select("path", "line", F.explode(every).alias("x")).select("path", "line", "x.kind", F.lit(None).cast("string").alias("locale"), "x.text")


def _sides(rows: DataFrame, key: Column, value: Column) -> DataFrame:
    sides = F.array(F.struct(F.lit(KINDS[0]).alias("kind"), F.lit(None).cast("string").alias("locale"), key.alias("text")), F.struct(F.lit(KINDS[1]).alias("kind"), F.col("locale"), value.alias("text")))
    return rows.select("path", "line", F.explode(sides).alias("x")).select("path", "line", "x.*")


def property_strings(files: DataFrame) -> DataFrame:
    lines = _lines(files).withColumn("s", trimmed(F.col("s"))).withColumn("locale", locale_of(F.col("path")))
    lines = lines.where("s <> '' AND s NOT LIKE '#%' AND s NOT LIKE '!%' AND s LIKE '%=%'")
    return _sides(lines, F.split_part("s", F.lit("="), F.lit(1)), F.regexp_replace("s", "^[^=]*=", ""))


def json_strings(files: DataFrame) -> DataFrame:
    """Keys and values of JSON files, by levels; deeper than DEEPEST ends with an error, so that nothing is lost unseen."""
    spark = files.sparkSession
    front, n = sized(files.select("path", locale_of(F.col("path")).alias("locale"), F.lit(None).cast("string").alias("key"), F.try_parse_json(F.col("text")).alias("v")).where("v IS NOT NULL").withColumn("v", F.to_json("v")))
    out, levels = None, [front]
    for _ in range(DEEPEST):
        if not n:
            break
        here = front.select("path", "locale", "key", F.parse_json("v").alias("v"), F.schema_of_variant(F.parse_json("v")).alias("kind"))
        keys = here.where("key IS NOT NULL").select("path", F.lit(0).cast("long").alias("line"), F.lit(KINDS[0]).alias("kind"), F.lit(None).cast("string").alias("locale"), F.col("key").alias("text"))
        values = here.where("kind = 'STRING'").select("path", F.lit(0).cast("long").alias("line"), F.lit(KINDS[1]).alias("kind"), "locale", F.variant_get("v", "$", "string").alias("text"))
        both = keys.unionByName(values)
        out = both if out is None else out.unionByName(both)
        nested = here.where("kind LIKE 'OBJECT%' OR kind LIKE 'ARRAY%'").select("path", "locale", "v")
        nested.createOrReplaceTempView("__quillon_nested")
        inner = spark.sql("SELECT path, locale, e.key AS key, to_json(e.value) AS v FROM __quillon_nested, LATERAL variant_explode(v) AS e(pos, key, value)")
        front, n = sized(inner)
        levels.append(front)
    if n:
        raise ValueError(f"a JSON file is nested deeper than {DEEPEST} levels")
    if out is None:
        released(*levels)
        return spark.createDataFrame([], "path string, line long, kind string, locale string, text string")
    return out


def ui_strings(files: DataFrame) -> DataFrame:
    """``path, line, kind, locale, text`` of all files."""
    p = F.col("path")
    mine = files.where(is_candidate(p) & F.col("text").isNotNull()).select("path", "text")
    spoken = mine.where(is_translation(p))
    parts = [component_strings(mine.where(~is_translation(p))), property_strings(spoken.where(F.lower("path").endswith(".properties"))), json_strings(spoken.where(F.lower("path").endswith(".json")))]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("text", trimmed(F.col("text")))
    return out.where((F.col("text") != "") & (F.octet_length("text") <= LONGEST)).distinct()
