"""Lexical and weighted ranking: BM25, churn, scores of candidates and facts, greedy filling of a budget.

Edge cases: null texts have no terms; no documents or no queries give no rows; a null among the terms of a score makes it null; a cost beyond 0 and 1 is
clamped; ties are broken where an order is asked for, by the columns that the caller names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import terms
from ..functions.words import is_noise_word
from .settle import sized

K1, B = 1.2, 0.75
RANK = {"seed": 1.0, "graph": 0.8, "churn": 0.3, "recency": 0.2, "history": 0.6, "fact": 0.5, "test": 0.3, "arch": 0.3}
COST, LEAST, PER_COMPONENT = 0.4, 0.15, 3


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id, score`` above zero. A term that a query repeats counts as often.

    Only terms of some query are exploded past the first semi join; lengths need no shuffle.
    """
    t = docs.select("doc_id", terms(F.col("text")).alias("t")).withColumn("len", F.size("t"))
    stats = t.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"))
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("times"))
    tf = t.select("doc_id", "len", F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # as large as the queries' vocabulary: broadcast if counted to be small, so that the postings of a common term go nowhere
    weights, _ = sized(asked.join(df, "term").crossJoin(F.broadcast(stats)).select("query_id", "term", "avg", (idf * F.col("times")).alias("idf")))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return tf.join(weights, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("idf") * norm).alias("score")).where("score > 0")


def query_overlap(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, overlap``: how many different words of a query, but noise, are in fewer than half of the documents and in one at least. No documents: none."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    asked = queries.where("text IS NOT NULL").select("query_id", F.explode(terms(F.col("text"))).alias("term")).where(~is_noise_word(F.col("term"))).distinct()
    words = docs.where("text IS NOT NULL").select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    df = words.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).where("df < ceil(n / 2)")
    hits = asked.join(df, "term").groupBy("query_id").agg(F.count(F.lit(1)).alias("overlap"))
    return queries.select("query_id").distinct().join(hits, "query_id", "left").select("query_id", F.coalesce("overlap", F.lit(0)).alias("overlap"))


def churn(touches: DataFrame, key: str) -> DataFrame:
    """``key, churn``: ln(n + 1) / ln(most + 1)."""
    n = touches.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    most = n.agg(F.max("n").alias("most"))
    return n.crossJoin(F.broadcast(most)).select(key, (F.log(F.col("n") + 1) / F.log(F.col("most") + 1)).alias("churn"))


def score(**of: Column) -> Column:
    """Weighted sum of the named terms, less the clamped cost."""
    cost = F.least(F.greatest(of.pop("cost"), F.lit(0.0)), F.lit(1.0))
    return sum((RANK[k] * v for k, v in of.items()), F.lit(0.0)) - COST * cost


def subject_match(subject: Column, seeds: Column) -> Column:
    """How near a fact's subject is to the seeds (an array): one of them 1, a module of one or within one 0.6, else 0.3, also without either."""
    below = lambda short, long: long.startswith(short) & (F.length(long) > F.length(short)) & F.substring(long, F.length(short) + 1, F.lit(1)).isin(":", ".", "#", "/", "(")
    each = F.transform(seeds, lambda s: F.when(s == subject, 1.0).when(below(subject, s) | below(s, subject), 0.6).otherwise(0.0))
    return F.greatest(F.coalesce(F.array_max(each), F.lit(0.3)), F.lit(0.3))


def relevance(match: Column, source: Column, state: Column, age: Column, confidence: Column) -> Column:
    """Of a fact: product of its match, source, state, decay and confidence."""
    s = F.when(source == "human", 1.0).when(source == "deterministic", 0.9).otherwise(0.7)
    t = F.when(state == "durable", 1.0).when(state == "validated", 0.85).otherwise(0.6)
    return match * s * t * F.greatest(F.least(F.exp(-age / 40.0), F.lit(1.0)), F.lit(0.05)) * confidence


def filled(candidates: DataFrame, budget: int, least: float = LEAST, per_component: int = PER_COMPONENT, spent: int = 0, ordered: bool = False) -> DataFrame:
    """The ledger of a greedy fill for each request: ``request_id, item, included, reason``.

    ``candidates``: request_id, item, score, tokens, component, position and maybe anchor; ids are of any type. They go by score per token, then position, then
    item; one without tokens goes last. A candidate without an anchor, of unknown size, below the floor, or of a component of which so many are
    included is left out; one that doesn't fit is passed over and later, smaller ones may still enter. Empty and null components have no limit. ``ordered`` keeps
    the given order, without floor and limit. Spark sorts the requests; the fold goes through a partition's rows and holds what one request has spent,
    so neither many requests nor a large one cost more than their rows. A null score counts as zero, null tokens are an unknown size, tokens below zero count as none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema.fields}
    score, tokens = (F.col(c).cast("double") for c in ("score", "tokens"))
    score, tokens = F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0)), F.when(tokens.isNotNull() & ~F.isnan(tokens), F.greatest(tokens, F.lit(0.0)))
    anchored = F.col("anchor").isNotNull() if kinds.get("anchor") == "string" else F.lit("anchor" not in kinds)
    component = F.when(F.col("component") != "", F.col("component")) if kinds["component"] == "string" and not ordered and per_component > 0 else F.lit(None).cast("string")
    density = F.when(tokens > 0, score / tokens).otherwise(-np.inf)
    order = [F.when(~F.isnan("d"), F.col("d")).desc_nulls_last()] * (not ordered) + [F.asc_nulls_last("position"), F.asc_nulls_last("item")]
    floor = F.lit(False) if ordered else score < least
    # what a row alone decides has its number here: 1 no anchor, 2 unknown size, 3 below the floor; the fold knows 0 selected, 4 its component is full, 5 the budget is
    alone = F.when(~anchored, 1).when(tokens.isNull(), 2).when(floor, 3).otherwise(0)
    rows = candidates.select("request_id", "item", "position", alone.cast("int").alias("why"), tokens.alias("tokens"), component.alias("component"), density.alias("d"))
    first = F.row_number().over(Window.partitionBy("request_id").orderBy(*order)) == 1
    rows = rows.select("request_id", "item", "component", "why", "tokens", first.alias("first"))

    def fold(batches):
        used, count = spent, {}
        for b in batches:
            first, tokens, component = (b.column(c).to_pylist() for c in ("first", "tokens", "component"))
            why = b.column("why").to_pylist()
            for i, w in enumerate(why):
                if first[i]:
                    used, count = spent, {}
                if w:
                    continue
                c = component[i]
                if c is not None and count.get(c, 0) >= per_component:
                    why[i] = 4
                elif used + tokens[i] > budget:
                    why[i] = 5
                else:
                    used += tokens[i]
                    if c is not None:
                        count[c] = count.get(c, 0) + 1
            yield pa.RecordBatch.from_arrays([b.column("request_id"), b.column("item"), b.column("component"), pa.array(why, pa.int32())], ["request_id", "item", "component", "why"])

    told = rows.mapInArrow(fold, f"request_id {kinds['request_id']}, item {kinds['item']}, component string, why int")
    why = F.col("why")
    reason = F.when(why == 0, "selected").when(why == 1, "no file:line anchor").when(why == 2, "unknown size").when(why == 3, f"below floor ({least:.2f})")
    reason = reason.when(why == 4, F.concat(F.lit(f"at most {per_component} items from "), "component")).otherwise(f"budget exhausted at {budget} tokens")
    return told.select("request_id", "item", (why == 0).alias("included"), reason.alias("reason"))


def top(df: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r") <= k).drop("r")


__all__ = ["bm25", "churn", "filled", "relevance", "score", "top"]
