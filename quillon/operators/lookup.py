"""Looking up symbols: by a target in words, by container, by place.

``symbols``: fqn, kind, file_path, start_line and maybe deleted (such rows are passed over) and name (else the last segment of fqn).
Comparisons of endings ignore the case of ASCII letters; signs of a target stand for themselves. Ties of order go by name.

Edge cases: an unknown target gives no rows, of ``target_state`` the state not_found; null names and paths match nothing; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import graphql_coordinate, seed_segment

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Matches looked at, and lines of a block of places.
LIMIT, BLOCK = 25, 64


def live(symbols: DataFrame) -> DataFrame:
    out = symbols.where(~F.coalesce("deleted", F.lit(False))) if "deleted" in symbols.columns else symbols
    return out if "name" in symbols.columns else out.withColumn("name", seed_segment(F.col("fqn")))


def folded(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def named(target: str) -> Column:
    """Whether a symbol's name is the target, or its full name is or ends with it, with or without parameters."""
    t = target.translate(str.maketrans(UPPER, LOWER))
    low = folded(F.col("fqn"))
    return (F.col("fqn") == target) | low.endswith(t) | low.contains(t + "(") | (F.col("name") == target)


def is_path(target: str) -> bool:
    return "/" in target or target.endswith((".java", ".ts"))


def find_symbols(symbols: DataFrame, target: str, limit: int = LIMIT) -> DataFrame:
    """The symbols a target may mean: routes of a GraphQL coordinate, all of a path by line, or by name, the shortest first."""
    s, length = live(symbols), F.length("fqn")
    if target.startswith("graphql:"):
        coordinate = target.removeprefix("graphql:").rpartition(":")[2]
        return s.where((F.col("fqn") == target) | (graphql_coordinate(F.col("fqn")) == coordinate)).orderBy(length, "fqn").limit(limit)
    if is_path(target):
        return s.where(F.col("file_path") == target).orderBy("start_line", "fqn").limit(limit)
    return s.where(named(target)).orderBy(length, "fqn").limit(limit)


def find_by_word(symbols: DataFrame, word: str, limit: int = LIMIT) -> DataFrame:
    """As ``find_symbols`` by name, and after those symbols with the word in their name."""
    inside = folded(F.col("name")).contains(word.translate(str.maketrans(UPPER, LOWER)))
    return live(symbols).where(named(word) | inside).orderBy(named(word).desc(), F.length("fqn"), "fqn").limit(limit)


def target_state(symbols: DataFrame, target: str, limit: int = LIMIT) -> DataFrame:
    """``state, fqn``: one with its symbols, ambiguous with the candidates, or not_found with a null.

    A target is one if it is a full name, if it matches one symbol, or if it is a path.
    """
    found = find_symbols(symbols, target, limit)
    n, exact = F.count(F.lit(1)), F.count_if(F.col("fqn") == target)
    files = F.count_distinct("file_path")
    how = found.agg(F.when(n == 0, "not_found").when((exact > 0) | (n == 1) | ((files == 1) & F.lit("/" in target or target.endswith(".java"))), "one").otherwise("ambiguous").alias("state"), (exact > 0).alias("exact"))
    rows = F.broadcast(how).join(found.select("fqn"), F.lit(True), "left")
    return rows.where(~F.col("exact") | (F.col("fqn") == target)).select("state", "fqn")


def members_of(symbols: DataFrame, container: str) -> DataFrame:
    """What stands right or deeper below a container."""
    f = F.col("fqn")
    return live(symbols).where(f.startswith(container + "#") | f.startswith(container + ".") | f.startswith(container + "::"))


def symbol_at(symbols: DataFrame, places: DataFrame) -> DataFrame:
    """``file_path, line, fqn``: of the spans (``start_line`` to ``end_line``) that hold a place (``file_path, line``) the narrowest, the first by name on ties.

    Spans are cut into blocks of lines, so a file of many symbols is many keys.
    """
    block = lambda c: F.floor(F.col(c) / BLOCK).cast("long")
    spans = live(symbols).where("start_line <= end_line").select("file_path", "fqn", "start_line", "end_line", F.explode(F.sequence(block("start_line"), block("end_line"))).alias("block"))
    asked = places.select("file_path", "line").distinct().withColumn("block", block("line"))
    held = asked.join(spans, ["file_path", "block"]).where(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = F.row_number().over(Window.partitionBy("file_path", "line").orderBy(F.col("end_line") - F.col("start_line"), "fqn"))
    return held.withColumn("r", best).where("r = 1").select("file_path", "line", "fqn")
