"""Audit of how filters interact: what each removes, in every order, by a packed bitmap index.

Every document is measured once into a few flag bits, which are written. Each task packs its rows' bits into NumPy bitsets, one for each filter
and label; rows are dealt by part first and every part begins at a byte, so a part's own bitset is a run of bytes. For each subset of
the filters, the subset's survivors are the part AND NOT its failures; their popcounts, alone and with each label, are summed over the
tasks by Spark. All orders follow from these sums: what a filter removes after a prefix is the difference of two subsets.

Edge cases: a null text is empty, a null part is the empty string; a label counts if any of a document's rows in ``labels`` is 1; a text equal
to that of a smaller id is a copy, whatever its part, so rows repeated with one id and text aren't copies of each other, and a row without an id
neither is a copy nor has one; texts are equal if 128 bits of their hash are; no documents give no rows; columns of other names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices

FILTERS = "ABCDE"
LABELS = ("good", "toxic")
#: Parts whose sums a task holds before it hands them on.
PARTS = 4096
MARKS = set(b"#$%&*|")
#: Bytes of UTF-8 that begin no code point.
CONTINUED = bytes(range(0x80, 0xC0))


def failures(text: bytes) -> int:
    """Bits of the filters A to D that a text in UTF-8 fails."""
    words = text.split()  # on bytes: space and 9 to 13 only
    n = len(words)
    capitals = len(text) - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    points = len(text.translate(None, CONTINUED))
    return (n < 50) | (100 * len(set(words)) < 65 * n) << 1 | (100 * capitals > 5 * points) << 2 | (not MARKS.isdisjoint(text)) << 3


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``id, part, digest, bits`` of every row, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column(2).cast(pa.large_binary()).buffers()[1], np.int64)[: len(batch) + 1]) if len(batch) else []
            for start, stop in slices(sizes, 4_000_000):
                rows = batch.slice(start, stop - start)
                found = [(hashlib.blake2b(t, digest_size=16).digest(), failures(t)) for t in rows.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.int32())], ["id", "part", "digest", "bits"])

    slim = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("t"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(run, f"id {kind}, part string, digest binary, bits int")


def flagged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """``part, bits``: of every row its failures, copies included, and above them its labels.

    The first of each text is found by sums before any join, and joined by id and text, which no group of copies makes hot.
    """
    rows = cut(measured(docs, key, text, part))
    firsts = rows.groupBy("digest").agg(F.min("id").alias("id")).select("id", "digest", F.lit(True).alias("first"))
    marks = labels.select(F.col("doc_id").alias("id"), *[(F.col(c) == 1).alias(n) for c, n in zip(("quality", "toxic"), LABELS, strict=True)])
    marks = marks.groupBy("id").agg(*[F.coalesce(F.max(n), F.lit(False)).alias(n) for n in LABELS])
    copy = F.col("first").isNull() & F.col("id").isNotNull()
    out = rows.join(firsts, ["id", "digest"], "left").join(marks, "id", "left")
    bit = lambda c, k: F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    n = len(FILTERS)
    return out.select("part", (F.col("bits") + bit(copy, n - 1) + sum((bit(F.coalesce(F.col(c), F.lit(False)), n + i) for i, c in enumerate(LABELS)), F.lit(0))).cast("int").alias("bits"))


def survivors(flags: DataFrame, filters: int = len(FILTERS), labels: tuple[str, ...] = LABELS) -> DataFrame:
    """A row for each part with ``kept`` and one array for each label: at i, how many rows (with the label) survive the filters whose bits are set in i."""
    subsets, names = 1 << filters, ("kept", *labels)
    columns = [f"{c}_{i}" for c in names for i in range(subsets)]

    def index(part: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Where each part's run of bytes begins, and the bitsets: of the parts' rows, then of filters and labels."""
        sizes = np.bincount(part)
        starts = np.concatenate([[0], np.cumsum((sizes + 7) // 8)])
        order = np.argsort(part, kind="stable")
        place = np.empty(len(part), np.int64)
        place[order] = starts[part[order]] * 8 + np.arange(len(part)) - np.concatenate([[0], np.cumsum(sizes)])[part[order]]
        sets = []
        for held in [np.ones(len(bits), bool), *((bits >> k & 1).astype(bool) for k in range(filters + len(labels)))]:
            flat = np.zeros(starts[-1] * 8, bool)
            flat[place] = held
            sets.append(np.packbits(flat))
        return starts[:-1], sets

    def counts(part: np.ndarray, bits: np.ndarray) -> np.ndarray:
        starts, (there, *sets) = index(part, bits)
        fails, marks = sets[:filters], sets[filters:]
        out = []
        survive = [there]
        for i in range(1, subsets):  # each subset is one filter more than a smaller one
            k = i.bit_length() - 1
            survive.append(survive[i ^ (1 << k)] & ~fails[k])
        for within in [None, *marks]:
            out += [np.add.reduceat(np.bitwise_count(s if within is None else s & within).astype(np.int64), starts) for s in survive]
        return np.stack(out, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            table = np.stack(list(sums.values()))
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), *(pa.array(table[:, i]) for i in range(len(columns)))], ["part", *columns])

        for batch in batches:
            if not len(batch):
                continue
            coded = batch.column(0).dictionary_encode()
            for name, row in zip(coded.dictionary.to_pylist(), counts(coded.indices.to_numpy(), batch.column(1).to_numpy()), strict=True):
                sums[name] = sums[name] + row if name in sums else row
            if len(sums) >= PARTS:
                yield told()
                sums.clear()
        if sums:
            yield told()

    partial = flags.mapInArrow(run, "part string, " + ", ".join(f"{c} long" for c in columns))
    total = partial.groupBy("part").agg(*[F.sum(c).alias(c) for c in columns])
    return total.select("part", *[F.array(*[F.col(f"{c}_{i}") for i in range(subsets)]).alias(c) for c in names])


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` of every order of the filters, from ``survivors``."""
    n, whole = len(filters), (1 << len(filters)) - 1
    orders = ["".join(p) for p in permutations(filters)]
    before = [sum(1 << filters.index(c) for c in o[:k]) for o in orders for k in range(n)]
    at = lambda c, i: F.element_at(F.col(c), (F.lit(i) if isinstance(i, int) else i) + 1)
    share = []
    for k in range(n):
        terms = [(s, _factorial(s.bit_count()) * _factorial(n - 1 - s.bit_count())) for s in range(whole + 1) if not s >> k & 1]
        share.append(sum((w * (at("kept", s) - at("kept", s | 1 << k)) for s, w in terms), F.lit(0).cast("long")))
    steps = counts.withColumn("shares", F.array(*share)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1))))
    steps = steps.withColumn("filter_order", F.element_at(F.lit(orders), (F.col("i") / n).cast("int") + 1)).withColumn("step", (F.col("i") % n + 1).cast("int"))
    k = F.instr(F.lit(filters), F.substring(F.col("filter_order"), F.col("step"), F.lit(1))) - 1
    steps = steps.withColumn("s", F.element_at(F.lit(before), F.col("i") + 1)).withColumn("k", k).withColumn("f", F.element_at(F.lit([1 << j for j in range(n)]), F.col("k") + 1))
    then = F.col("s") + F.col("f")
    gone = lambda c: at(c, F.col("s")) - at(c, then)
    fails = at("kept", 0) - at("kept", F.col("f"))
    alone = at("kept", F.lit(whole) - F.col("f")) - at("kept", whole)
    return steps.select("part", "filter_order", "step", at("kept", then).alias("kept"), gone("kept").alias("removed"), (fails - gone("kept")).alias("redundant"), alone.alias("unique_fails"), *[gone(c).alias(f"{c}_lost") for c in LABELS], F.element_at("shares", F.col("k") + 1).alias("shapley"))


def _factorial(n: int) -> int:
    return n * _factorial(n - 1) if n else 1


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """The audit of the five filters over whole texts."""
    return audit(survivors(flagged(docs, labels, key, text, part)))


ORACLE_SQL = r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS lead FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, (len(w) < 50)::INT + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce((lead < w.doc_id)::INT, 0) AS bits,
 coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
g AS (SELECT part, bits, good, toxic, count(*) AS n FROM m GROUP BY ALL),
f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step::INT AS step, (SELECT bit FROM f WHERE letter = filter_order[step]) AS bit, coalesce((SELECT sum(bit) FROM f WHERE contains(filter_order[1:step - 1], letter)), 0)::INT AS before FROM o, unnest(range(1, 6)) AS u(step)),
r AS (SELECT part, filter_order, step, s.bit, coalesce(sum(n) FILTER (bits & (before + s.bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (bits & before = 0 AND bits & s.bit > 0), 0)::BIGINT AS removed,
 coalesce(sum(n) FILTER (bits & before > 0 AND bits & s.bit > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (bits = s.bit), 0)::BIGINT AS unique_fails,
 coalesce(sum(n) FILTER (bits & before = 0 AND bits & s.bit > 0 AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (bits & before = 0 AND bits & s.bit > 0 AND toxic), 0)::BIGINT AS toxic_lost FROM s, g GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
