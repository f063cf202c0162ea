"""Quality rules with adaptive thresholds.

Measures of each text are gathered into quantile sketches per language and source. A sketch is a histogram over
logarithmic buckets (every quantile within 1 % of a value that occurs): merging is adding counts, so partial sketches
merge in any order, results don't depend on the partitions, and a hot source is summed before it is shuffled. From the
sketches come upper and lower fences per language and source; the fences of a small source lean on those of its
language. The fences are joined to the rows by language and source, and a row outside any of them is rejected.

Fixed rules (``base_failed``) stand beside the fences: too few words, or too many words in repeated 5-word windows.

Edge cases: a null or empty text has no words and fails; null languages and sources form groups of their own; equal
texts of a group share their verdict; extra columns are ignored or carried along, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_texts, works

# The base rules.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_punct long, n_upper long"
DROP_WORD = str.maketrans("", "", " \t\n\x0b\x0c\r")
#: Growth of the buckets of a sketch, and what is added to a value so that zero has a bucket.
GROWTH, LEAST = 1.02, 1e-3
#: Groups of language and source up to which their fences are broadcast (some 200 bytes each).
MOST_BROADCAST = 20_000
#: Rows of a source at which its own fences weigh as much as those of its language.
PRIOR = 200.0
#: Of each measure: its name, how far from the median a fence stands in units of the upper or lower half of the middle 80 %, the least distance, and which sides have one.
RULES = (("symbols", 6.0, 0.05, "upper"), ("punct", 6.0, 0.5, "upper"), ("upper", 6.0, 0.2, "upper"), ("repeated", 6.0, 0.10, "upper"), ("duplicated", 6.0, 0.35, "upper"), ("word_length", 6.0, 1.5, "both"))


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    key = ids[:n].copy()
    base = len(number)
    top = base
    for k in range(1, window):  # exact: a window's number, made dense again before it could overflow
        if top > (1 << 62) // base:
            key = np.unique(key, return_inverse=True)[1]
            top = n
        key = key * base + ids[k : n + k]
        top *= base
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    at = np.flatnonzero(twice)
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, at, 1)
    np.add.at(marks, at + window, -1)
    return int((np.cumsum(marks) > 0).sum())


def measures(text: str | None) -> tuple[int, ...]:
    """The counts of SCHEMA."""
    if not text:
        return (0,) * 8
    raw = text.encode()
    words = raw.split()
    lines = text.split("\n")
    seen: set[str] = set()
    copies = worded = 0
    for line in lines:
        if line and line.translate(DROP_WORD):
            worded += 1
            if line in seen:
                copies += 1
            seen.add(line)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    return (len(words), len(text) - blanks, sum(map(text.count, SYMBOLS)), copies, repeated_words(words), worded, len(raw) - len(raw.translate(None, PUNCTUATION.encode())), upper(raw))


def upper(raw: bytes) -> int:
    return len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))


def _work():
    works("quality")
    return lambda texts: [measures(x) for x in texts]


def measured(docs: DataFrame, carry: list[str], text: str = "text", into: str = "__m") -> DataFrame:
    """The carried columns and a struct of the counts of each text."""
    return map_texts(docs, _work, SCHEMA, carry, text, into)


def ratios(m: Column) -> dict[str, Column]:
    words, chars = F.greatest(m["n_words"], F.lit(1)), F.greatest(m["word_chars"], F.lit(1))
    return {"symbols": m["n_symbols"] / chars, "punct": m["n_punct"] / words, "upper": m["n_upper"] / chars, "repeated": m["n_repeat_words"] / words, "duplicated": m["n_dup_lines"] / F.greatest(m["n_lines"], F.lit(1)), "word_length": m["word_chars"] / words}


def base_failed(m: Column) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * m["n_words"])


def sketches(rows: DataFrame, m: str = "__m", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang, source, measure, bucket, n``: the sketches of the rows; to merge sketches, add ``n`` by the other columns."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.ceil(F.log(v + LEAST) / float(np.log(GROWTH))).cast("int").alias("bucket")) for k, v in ratios(F.col(m)).items()]))
    return rows.select(F.col(lang).alias("lang"), F.col(source).alias("source"), each.alias("e")).groupBy("lang", "source", "e.measure", "e.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """``by``, ``rows`` and the named quantiles of each group's merged sketch."""
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by)
    seen = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("rows", F.sum("n").over(w))
    value = F.pow(F.lit(GROWTH), F.col("bucket") - F.lit(0.5)) - LEAST
    return seen.groupBy(*by).agg(F.max("rows").alias("rows"), *[F.greatest(F.min(F.when(F.col("upto") >= F.col("rows") * q, value)), F.lit(0.0)).alias(k) for k, q in at.items()])


def fences(sketch: DataFrame) -> DataFrame:
    """``lang, source`` and for each measure the lowest and highest value that passes."""
    at = {"low": 0.1, "mid": 0.5, "high": 0.9}
    own = quantiles(sketch, ["lang", "source", "measure"], at)
    wide = quantiles(sketch, ["lang", "measure"], at).select(F.col("lang").alias("l"), F.col("measure").alias("m"), *[F.col(k).alias(f"wide_{k}") for k in at])
    both = own.join(wide, own["lang"].eqNullSafe(wide["l"]) & (own["measure"] == wide["m"]), "left")
    share = F.col("rows") / (F.col("rows") + PRIOR)
    rule = {k: F.element_at(F.create_map(*[x for r in RULES for x in (F.lit(r[0]), F.lit(r[i]))]), F.col("measure")) for k, i in (("times", 1), ("least", 2), ("sides", 3))}
    # the tighter of a source and its language: a source of mostly junk doesn't widen its own fences
    high = F.least(F.col("high") - F.col("mid"), F.col("wide_high") - F.col("wide_mid"))
    low = F.least(F.col("mid") - F.col("low"), F.col("wide_mid") - F.col("wide_low"))
    middle = share * F.col("mid") + (1 - share) * F.col("wide_mid")
    upper_end = middle + F.greatest(rule["times"] * high, rule["least"])
    lower_end = F.when(rule["sides"] == "both", middle - F.greatest(rule["times"] * low, rule["least"])).otherwise(F.lit(-1.0))
    ends = both.select("lang", "source", "measure", upper_end.alias("upper_end"), lower_end.alias("lower_end"))
    return ends.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == r[0], F.struct("lower_end", "upper_end"))).alias(r[0]) for r in RULES])


def judged(rows: DataFrame, measures: DataFrame, m: str = "__m", lang: str = "lang", source: str = "source", into: str = "__kept") -> DataFrame:
    """``rows`` with a verdict, by the fences of the rows ``measures``. The fences are written first and broadcast only if they are few."""
    f = cut(fences(sketches(measures, m, lang, source)).select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.struct(*[r[0] for r in RULES]).alias("__fence")))
    few = F.broadcast(f) if f.count() <= MOST_BROADCAST else f
    joined = rows.join(few, rows[lang].eqNullSafe(f["__lang"]) & rows[source].eqNullSafe(f["__source"]), "left")
    inside = F.lit(True)
    for k, v in ratios(F.col(m)).items():
        end = F.col("__fence")[k]
        inside = inside & v.between(end["lower_end"] - 1e-9, end["upper_end"] + 1e-9)
    return joined.withColumn(into, ~base_failed(F.col(m)) & F.coalesce(inside, F.lit(True))).drop("__lang", "__source", "__fence")


def quality(docs: DataFrame, carry: list[str] | None = None, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The carried columns (all by default; none may be named like the two that follow) with the struct ``__m`` of counts and the verdict ``__kept``.

    The measures are written once to the shared folder, for the sketches and for the filter; where texts are carried along, they are
    measured twice instead, so that no copy of them is written or shuffled.
    """
    carry = carry or docs.columns
    rows = measured(docs, carry, text)
    if text in carry:
        return judged(rows, measured(docs, [lang, source], text), lang=lang, source=source)
    rows = cut(rows)
    return judged(rows, rows, lang=lang, source=source)
