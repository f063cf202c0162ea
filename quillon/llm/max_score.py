"""Exact top k by inner product, with MaxScore over signed posting lists.

A component of a vector is a term; its posting lists are the vectors where it is above zero and those where it is below. A query's component
meets the list of its own sign, where the product is positive and at most the query's value times the list's greatest; the other list only lowers
a score. Queries and candidates are dealt to a grid of shards and blocks of bounded size. In each cell the rows of a shard are gone through
in stretches. While a query's ``k``-th best score stands at t, the terms of least bounds whose bounds sum to less than t are non-essential: a
row in no essential list can't reach t and isn't looked at. Rows from the essential lists are scored there, then probed term by term for the
others, greatest bound first, and dropped as soon as what is still possible falls below t. Each cell's best are merged by Spark.

Edge cases: null vectors and those with null or non-finite components take no part; a vector that is shorter counts as zero beyond its end, so one
without components scores 0; all rows of the query's id are its own and no candidates; candidates repeated with one id count as often as they
are there; of query rows with one id the least vector asks; rows without an id take no part; ties go to the
smaller id; no queries or candidates give no rows. Values of which a score may pass 63 bits raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Candidates of a shard, queries of a block, and rows gone through at once.
SHARD, BLOCK, STRETCH = 16_384, 1_024, 2_048


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """One row for each list of integers, zero beyond its end."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy()
    return out


class Postings:
    """The lists of a shard: for each component the rows above and below zero as bits of a matrix, with the greatest value of each list."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.columns = ids, np.ascontiguousarray(values.T)
        self.lists = (self.columns > 0, self.columns < 0)
        self.most = (np.maximum(self.columns.max(1, initial=0), 0), np.maximum(-self.columns.min(1, initial=0), 0))

    def best(self, query: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the ``k`` best for a query, by score and id."""
        terms = np.flatnonzero(q)
        bound = np.where(q[terms] > 0, self.most[0][terms] * q[terms], self.most[1][terms] * -q[terms])
        order = np.argsort(-bound, kind="stable")
        terms, bound = terms[order], bound[order]
        rest = np.concatenate([np.cumsum(bound[::-1])[::-1], [0]])  # of the terms from each on
        top, top_ids = np.empty(0, np.int64), np.empty(0, np.int64)
        for start in range(0, len(self.ids), STRETCH):
            span = slice(start, min(start + STRETCH, len(self.ids)))
            full = len(top) == k
            t = top[-1] if full else None
            rows = np.flatnonzero(self.ids[span] != query)
            # essential: the first terms, until what the rest can give is less than t; with t of 0 or less even rows in no list count
            e = int(np.searchsorted(-rest, -t, side="right")) if full and t > 0 else len(terms)
            essential = terms[:e]
            if full and t > 0:
                met = np.zeros(span.stop - start, bool)
                for d in essential:
                    met |= self.lists[0 if q[d] > 0 else 1][d, span]
                rows = rows[met[rows]]
            scores = q[essential] @ self.columns[essential, span][:, rows] if e else np.zeros(len(rows), np.int64)
            for i in range(e, len(terms)):
                competes = scores + rest[i] >= t
                rows, scores = rows[competes], scores[competes]
                if not len(rows):
                    break
                scores = scores + q[terms[i]] * self.columns[terms[i], start + rows]
            if len(rows):
                top, top_ids = np.concatenate([top, scores]), np.concatenate([top_ids, self.ids[span][rows]])
                first = np.lexsort((top_ids, -top))[:k]
                top, top_ids = top[first], top_ids[first]
        return top, top_ids


def integers(vector: Column, scale: int) -> Column:
    """The components times ``scale``, rounded down; null if the vector or a component is null or not finite."""
    x = lambda c: c.cast("double")
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(x(c)) & (F.abs(x(c)) < float("inf")))
    return F.when(fine, F.transform(vector, lambda c: F.floor(x(c) * float(scale)).cast("long")))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``query_id, rank, id, score``: of each query (``id, v``: a list of longs) the ``k`` candidates of the greatest inner product."""
    queries = queries.where("id IS NOT NULL AND v IS NOT NULL").groupBy("id").agg(F.min("v").alias("v"))
    # a candidate is dealt by its number and not by its id, of which one may have many rows; written, so that the number stays
    candidates = cut(candidates.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v", F.monotonically_increasing_id().alias("number")))
    n = candidates.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    m = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("d")).first()
    width, shards, blocks = max(n.d, m.d, 1), max(1, -(-n.n // shard)), max(1, -(-m.n // block))

    dealt = lambda c, parts: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")

    def cell(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return rows.column("id").to_numpy(), matrix(rows.column("v"), width)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, values = cell(left)
        asked, of = cell(right)
        out = []
        if len(ids) and len(asked):
            if float(np.abs(values).max(initial=0)) * float(np.abs(of).max(initial=0)) * width >= 2.0**63:
                raise ValueError("a score may pass 63 bits: take a smaller scale")
            lists = Postings(ids, values)
            for query, q in zip(asked, of, strict=True):
                scores, found = lists.best(query, q, k)
                out.append((np.full(len(found), query), found, scores))
        cols = [np.concatenate([x[i] for x in out]) if out else np.empty(0, np.int64) for i in range(3)]
        return pa.table({"query_id": cols[0].astype(np.int64), "id": cols[1].astype(np.int64), "score": cols[2].astype(np.int64)})

    left = candidates.select("id", "v", dealt("number", shards).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    right = queries.select("id", "v", dealt("id", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    each = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(scored, "query_id long, id long, score long")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each vector whose id ``every`` divides the ``k`` others with the greatest inner product of scaled components."""
    v = vectors.select(F.col(f"`{key}`").cast("long").alias("id"), integers(F.col(f"`{vector}`"), scale).alias("v"))
    return top_k(v.where(F.col("id") % every == 0), v, k).withColumnRenamed("id", "vec_id")


ORACLE_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0))), 0)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
