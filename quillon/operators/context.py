"""From a request in words to what it asks and the symbols it starts from.

Intents: a dictionary of phrases, of fixed size and broadcast, meets the runs of words of a text; most phrases found win, then the dictionary's
order; a stack trace outweighs one stray phrase. Seeds: words shaped like code are looked up by the ends of names, plain words only if
they are one symbol's whole name, or else a part of few names, joined through tables of names, their parts and their trigrams; no step
compares every word with every symbol.

Edge cases: a null or blank text is unknown and has no seeds; of more than 256 words those shaped like code go first, each group in order of code
points; a plain word that several symbols are called seeds none, nor does one that is part of more than six names or inside 200 or more; a symbol
found in several ways keeps its best source and its best strength; containers bring their first hundred members by line; deleted symbols are never found;
ties go by length and then name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import graphql_coordinate, name_tokens, seed_segment, terms
from ..functions.words import looks_like_code, targets
from .lookup import folded, live
from .settle import settled

# Phrases by intent, both in the order that decides ties; marks of a stack trace; words that point at the turn before.
INTENTS = {
    "debug": ("fix", "fixes", "fixing", "bug", "bugs", "broken", "breaks", "fails", "failing", "failure", "error", "errors", "crash", "crashes", "wrong", "regression"),
    "refactor": ("refactor", "rename", "renames", "move", "moves", "extract", "inline", "restructure", "clean up", "tidy"),
    "build": ("add", "adds", "implement", "implements", "build", "support", "create", "introduce", "write"),
    "review": ("review", "check", "is this safe", "done", "audit", "verify"),
    "explain": ("why", "how does", "how do", "what is", "what are", "explain", "understand"),
}
TRACES = ("\n\tat ", "\n    at ", "traceback (most recent call last)", "exception", "panicked at")
REFERENTIAL = ("the same", "that", "those", "it", "them", "also", "now do", "again", "likewise")
# Sources and strengths, best first; what declares others; how many words, hits, names, symbols of a word and members count.
SOURCES = ("explicit", "exact", "changed", "name match", "text match", "fact subject", "carried")
TOKEN, PROSE, CODE = 0, 1, 2
CONTAINERS = ("class", "interface", "enum", "record", "module", "package", "trait", "struct")
WORDS, HITS, FAMILY, NAMED, MEMBERS = 256, 200, 6, 10, 100


def phrases(text: Column, longest: int = 3) -> Column:
    """The different runs of one to so many words of a text, in lower case."""
    words = terms(text)
    runs = [words]
    for n in range(2, longest + 1):
        # each run with the word behind it; the last ones have none
        longer = F.zip_with(runs[-1], F.slice(words, n, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        runs.append(F.array_compact(longer))
    return F.array_distinct(F.concat(*runs))


def is_referential(text: Column) -> Column:
    """Whether a text points at the turn before it."""
    return F.coalesce(F.arrays_overlap(phrases(text, 2), F.array(*map(F.lit, REFERENTIAL))), F.lit(False))


def classified(requests: DataFrame) -> DataFrame:
    """``request_id, intent, signal, confident`` of requests (``request_id, text`` and maybe ``anchored, carried``).

    With ``anchored`` (the text names code) and ``carried`` (the turn before left seeds), a text that only points back is referential if there are
    seeds to point at, and unknown else. Request ids are unique.
    """
    spark = requests.sparkSession
    rows = [(phrase, i, intent, k) for i, (intent, words) in enumerate(INTENTS.items()) for k, phrase in enumerate(words)]
    table = F.broadcast(spark.createDataFrame(rows, "phrase string, i int, intent string, k int"))
    hits = requests.select("request_id", F.explode(phrases(F.col("text"))).alias("phrase")).join(table, "phrase")
    by = hits.groupBy("request_id", "i", "intent").agg(F.count(F.lit(1)).alias("n"), F.min_by("phrase", "k").alias("signal"))
    best = by.groupBy("request_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "i", "intent", "signal")).alias("b")).select(F.col("request_id").alias("__r"), "b")
    low = F.lower("text")
    traced = F.lit(False)
    for mark in TRACES:
        traced = traced | low.contains(mark)
    b = F.col("b")
    trace = F.coalesce(traced, F.lit(False)) & (b.isNull() | ((b["intent"] != "debug") & (-b["n"] < 2)))
    intent = F.when(trace, "debug").otherwise(F.coalesce(b["intent"], F.lit("unknown")))
    signal = F.when(trace, "stack trace").otherwise(b["signal"])
    out = requests.join(best, F.col("request_id") == F.col("__r"), "left")
    if "anchored" in requests.columns:
        back = ~F.coalesce("anchored", F.lit(False)) & is_referential(F.col("text"))
        carried = F.coalesce("carried", F.lit(False))
        intent, signal = F.when(back & carried, "referential").when(back, "unknown").otherwise(intent), F.when(back & carried, "refers to the previous turn").when(back, F.lit(None)).otherwise(signal)
    return out.select("request_id", intent.alias("intent"), signal.alias("signal")).withColumn("confident", F.col("intent") != "unknown")


def find_many(symbols: DataFrame, asked: DataFrame) -> DataFrame:
    """``target, fqn`` and ``n``, the place in the order, of what each target (``target``) may mean, as ``lookup.find_symbols`` has it for one.

    Ends of names are compared as keys: of each name those of the lengths that targets have.
    """
    s = live(symbols).where("fqn IS NOT NULL").select("fqn", "name", "file_path", "start_line")
    t = asked.select("target").where("target IS NOT NULL").distinct()
    graphql, path = F.col("target").startswith("graphql:"), F.col("target").contains("/") | F.col("target").rlike(r"\.(java|ts)$")
    by_route = t.where(graphql).withColumn("key", graphql_coordinate(F.col("target"))).join(s.withColumn("key", graphql_coordinate(F.col("fqn"))).where("key IS NOT NULL"), "key").select("target", "fqn", F.length("fqn").alias("order"))
    by_path = t.where(~graphql & path).join(s, F.col("target") == F.col("file_path")).select("target", "fqn", F.col("start_line").alias("order"))
    words = t.where(~graphql & ~path).withColumn("key", folded(F.col("target")))
    lengths = F.broadcast(words.agg(F.collect_set(F.length("key")).alias("lengths")))
    low = folded(F.col("fqn"))
    pieces = F.split(low, r"\(")
    bases = F.concat(F.array(low), F.when(F.size(pieces) > 1, F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.array_join(F.slice(pieces, 1, i), "("))).otherwise(F.array().cast("array<string>")))
    ends = F.flatten(F.transform(bases, lambda b: F.transform(F.filter("lengths", lambda n: (n <= F.length(b)) & (n > 0)), lambda n: F.right(b, n))))
    keyed = s.crossJoin(lengths).select("fqn", F.explode(F.array_distinct(ends)).alias("key"))
    by_end = words.join(keyed, "key").select("target", "fqn")
    by_name = words.join(s.select("fqn", "name"), F.col("target") == F.col("name")).select("target", "fqn")
    by_word = by_end.unionByName(by_name).distinct().select("target", "fqn", F.length("fqn").alias("order"))
    every = by_route.unionByName(by_path).unionByName(by_word)
    return every.withColumn("n", F.row_number().over(Window.partitionBy("target").orderBy("order", "fqn"))).select("target", "fqn", "n")


def plain_seeds(symbols: DataFrame, words: DataFrame) -> DataFrame:
    """``target, fqn, strength`` of plain words (``target``): the one symbol called so, or else the few that have it as a part of their names."""
    s = settled(live(symbols).where("fqn IS NOT NULL").select("fqn", "name", seed_segment(F.col("fqn")).alias("last")).distinct())
    words = words.select("target").distinct()
    called = words.join(s, F.col("target") == F.col("last")).groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.min("fqn").alias("fqn"))
    called = settled(called)
    rest = words.join(called, "target", "left_anti").withColumn("token", F.lower("target"))
    parts = s.select("fqn", F.explode(F.array_distinct(name_tokens(F.col("last")))).alias("token"))
    sizes = parts.join(rest, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= FAMILY)
    family = settled(rest.join(sizes.select("token"), "token").join(parts, "token").select("target", "token", "fqn"))
    # a word inside very many names is a theme; counted over the names that share its first three signs
    asked = family.select("token").distinct().withColumn("gram", F.left("token", F.lit(3)))
    low = folded(F.col("name"))
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - 2, F.lit(1))), lambda i: F.substring(low, i, F.lit(3))))
    inside = s.select("fqn", low.alias("low"), F.explode(grams).alias("gram")).join(asked, "gram").where(F.col("low").contains(F.col("token")))
    themes = inside.groupBy("token").agg(F.count_distinct("fqn").alias("n")).where(F.col("n") >= HITS).select("token")
    family = family.join(themes, "token", "left_anti").select("target", "fqn", F.lit(TOKEN).alias("strength"))
    return called.where("n = 1").select("target", "fqn", F.lit(PROSE).alias("strength")).unionByName(family)


def seeds(requests: DataFrame, symbols: DataFrame, offered: DataFrame | None = None) -> DataFrame:
    """``request_id, fqn, source, strength``: where each request (``request_id, text``) starts; sources as numbers of SOURCES, less is better.

    ``offered`` (``request_id, target, source, most``) are targets from elsewhere, of which so many matches count: named by the caller, changed,
    subjects of facts, carried from the turn before.
    """
    t = F.col("t")
    split = requests.where("text IS NOT NULL").select("request_id", targets(F.col("text")).alias("t"))
    ordered = F.slice(F.concat(F.filter(t, looks_like_code), F.filter(t, lambda w: ~looks_like_code(w))), 1, WORDS)
    words = settled(split.select("request_id", F.explode(ordered).alias("target")))
    code = words.where(looks_like_code(F.col("target")))
    shaped = F.col("target").rlike("[./#]")
    asked = code.select("request_id", "target", F.when(shaped, SOURCES.index("exact")).otherwise(SOURCES.index("name match")).alias("source"), F.lit(NAMED).alias("most"))
    if offered is not None:
        asked = asked.unionByName(offered.select("request_id", "target", "source", "most"))
    asked = settled(asked)
    found = asked.join(find_many(symbols, asked), "target").where("n <= most").select("request_id", "fqn", "source", F.lit(CODE).alias("strength"))
    plain = words.where(~looks_like_code(F.col("target")))
    found = found.unionByName(plain.join(plain_seeds(symbols, plain), "target").select("request_id", "fqn", F.lit(SOURCES.index("name match")).alias("source"), "strength"))

    def merged(df: DataFrame) -> DataFrame:
        return df.groupBy("request_id", "fqn").agg(F.min("source").alias("source"), F.max("strength").alias("strength"))

    direct = settled(merged(found))
    s = live(symbols).select("fqn", "kind", "start_line")
    holders = direct.join(s.where(F.col("kind").isin(*CONTAINERS)).select("fqn").distinct(), "fqn", "left_semi").withColumnRenamed("fqn", "holder")
    # a member's name begins with its container's and a separator: every such beginning is a key
    cuts = F.filter(F.sequence(F.lit(1), F.length("fqn")), lambda i: F.substring(F.col("fqn"), i, F.lit(1)).isin("#", ".") | (F.substring(F.col("fqn"), i, F.lit(2)) == "::"))
    keyed = s.select("fqn", "start_line", F.explode(F.transform(cuts, lambda i: F.left(F.col("fqn"), i - 1))).alias("holder")).distinct()
    mine = keyed.join(holders.select("holder").distinct(), "holder", "left_semi")
    first = mine.withColumn("r", F.row_number().over(Window.partitionBy("holder").orderBy("start_line", "fqn"))).where(F.col("r") <= MEMBERS)
    members = holders.join(first.select("holder", "fqn"), "holder").select("request_id", "fqn", "source", "strength")
    return merged(direct.unionByName(members))
