"""N-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of word shingles (64-bit hashes of them). Two sets with a Jaccard index of at least t share a token among
the first ``n - ceil(t n) + 1`` of each in any order common to all, and share l tokens if both prefixes are l - 1 longer.
The order puts tokens that many sets have last and goes by hash otherwise. Each set takes the l with the least estimated
number of candidates: the postings of its prefix, over the l of them that a candidate has to share. Of two similar sets the
smaller shares l tokens in a shorter prefix of its own, so only that is looked up.

Light tokens (postings of at most COMMON sets) give candidate pairs, which have to share l of them and are bounded by sketches.
Each set is first compared with one of its candidates, the least by hash; of the other pairs only those between
different components of what that linked are compared.

Heavy tokens give no pairs. A posting is led by its least set by hash, and all postings with one leader are a group. A group has a
centre c, the tokens that most of a few of its sets near the leader have, and each of its sets x is replaced by the
difference D(x) = x ^ c. For any c, ``|x ^ y| = |D(x)| + |D(y)| - 2 |D(x) & D(y)|``, so with
``w(x) = (1 + t) |D(x)| - (1 - t) |x|`` a pair is linked if and only if ``2 (1 + t) |D(x) & D(y)| >= w(x) + w(y)``. Let m have the
least w. Pairs with ``w(x) + w(y) <= 0`` are all linked with m, so comparing with m is enough; every other link shares tokens of the
differences, in which what the group has in common doesn't occur: again a join on prefixes, of the rest of each difference that
another set shares, with the number that has to be shared known for each set. A group of n near copies so costs n comparisons and a join on
what sets it apart, not n squared. Sets far from their centre meet others of the posting directly, bounded by sketches; a
set is left out of that only if all that it can be linked with is near the centre (triangle inequality of the Jaccard distance).

Results are exact up to equal 64-bit hashes of different shingles, sets or texts. Texts are sent, not sets: they are smaller.

Edge cases: a null or empty text, or one of white space, has an empty set and is linked with nothing, not even with another
empty one; fewer words than a shingle are one token; equal texts and repeated rows share a component; a component is
named by its smallest id (null ids count only if there is no other); extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_CHARS, cut, drop, map_texts, remembers, slices, works
from .components import components

#: Longest l; from how many sets on a token is heavy (and, met again so often within batches, last in the order); and how many go last at most.
LONGEST_L, COMMON, MOST_COMMON = 4, 48, 500_000
#: Bits of the filter that thins out texts before they are shuffled for an exact check.
FILTER_BITS = 1 << 24
#: Least bits of a set's sketch.
SKETCH_BITS = 512
#: Sets that a centre is made of, and how many a task compares with one at most.
SAMPLE, PART = 15, 128
#: How far from a centre, in percent, a set is represented by its difference.
RING = 50
#: Words remembered by a worker.
REMEMBERED = 150_000


class Memo(dict):
    """Hashes of words."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        self[word] = h
        return h


@lru_cache(maxsize=1)
def memo() -> Memo:
    return Memo()


remembers("words", memo.cache_clear)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def chained(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full_like(parts[0], len(parts))
    with np.errstate(over="ignore"):
        for x in parts:
            h = mixed(h * np.uint64(0xD6E8FEB86659FD93) + x)
    return h


def token_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct tokens of each text."""
    works("words")
    split = [x.encode().lower().split() if x else [] for x in texts]  # both of ASCII only
    total = sum(map(len, split))
    words = np.fromiter(map(memo().__getitem__, (w for ws in split for w in ws)), np.uint64, total)
    shingles = chained([words[k : total - size + 1 + k] for k in range(size)]).view(np.int64) if total >= size else None
    out, at = [], 0
    for ws in split:
        n = len(ws)
        if n >= size:
            out.append(np.unique(shingles[at : at + n - size + 1]))
        elif n:
            out.append(chained([words[at + k : at + k + 1] for k in range(n)]).view(np.int64))
        else:
            out.append(np.empty(0, np.int64))
        at += n
    return out


def node_of(tokens: np.ndarray) -> int | None:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(tokens.tobytes())).astype(np.int64)) if len(tokens) else None


def prefix(n: int, percent: int) -> int:
    """How many tokens of a set a similar one must share one of."""
    return n + (-percent * n) // 100 + 1


def region(n: int, percent: int) -> int:
    """How many tokens of least hash are kept of a set: enough but for sets of many common tokens."""
    p = prefix(n, percent)
    return min(n, p + LONGEST_L - 1 + max(8, p // 5))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """For each class of tokens whether the set has an odd number; two differ in no more bits than the sets do in tokens.

    There are about as many classes as tokens, a power of two, so that sketches tell long sets apart, too.
    """
    bits = max(SKETCH_BITS, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount((tokens & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _sets(size: int, percent: int):
    def rows(texts):
        return [(node_of(t), len(t), t[: region(len(t), percent)] if len(t) else None, sketch(t) if len(t) else None) for t in token_sets(texts, size)]

    return rows


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens met more than once in a batch of sets, with how often."""
    for batch in batches:
        flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
        tokens, counts = np.unique(flat, return_counts=True)
        many = counts > 1
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(tokens[many]), pa.array(counts[many], pa.int64())], ["token", "count"])


def ordered(tokens: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """Tokens with common ones last, and how many aren't."""
    if not len(common):
        return tokens, len(tokens)
    at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
    last = common[at] == tokens
    return np.concatenate([tokens[~last], tokens[last]]), int((~last).sum())


def _prefixes(common: np.ndarray, percent: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, n, tokens, light``: prefixes for the longest l from regions; no tokens where the region doesn't tell."""
    for batch in batches:
        n = batch.column(1).to_numpy()
        flat, offsets = batch.column(2).flatten().to_numpy(zero_copy_only=False), batch.column(2).offsets.to_numpy() - batch.column(2).offsets[0].as_py()
        tokens, light = [], []
        for i in range(batch.num_rows):
            own = flat[offsets[i] : offsets[i + 1]]
            need = min(int(n[i]), prefix(int(n[i]), percent) + LONGEST_L - 1)
            got, some = ordered(own, common)
            known = some >= need or len(own) == n[i]
            tokens.append(got[:need] if known else None)
            light.append(min(some, need) if known else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens, pa.list_(pa.int64())), pa.array(light, pa.int32())], ["node", "n", "tokens", "light"])


def bits_of(ids: np.ndarray) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        a = mixed(ids.astype(np.int64).view(np.uint64))
        return [(a & np.uint64(FILTER_BITS - 1)).astype(np.int64), ((a >> np.uint64(32)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)]


def id_filter(ids: DataFrame) -> np.ndarray:
    """A filter of FILTER_BITS bits that all ids of one column pass; few others do while they are few.

    Each task makes its own in slices, which are joined by OR, so the driver gets the one filter only.
    """
    step = FILTER_BITS // 64

    def local(batches):
        bits = np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for at in bits_of(batch.column(0).to_numpy(zero_copy_only=False)):
                bits[at] = True
        used = [k for k in range(64) if bits[k * step : (k + 1) * step].any()]
        if used:
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([np.packbits(bits[k * step : (k + 1) * step]).tobytes() for k in used])], ["k", "bits"])

    def either(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(step // 8, np.uint8)
        for batch in batches:
            for x in batch.column("bits"):
                total |= np.frombuffer(x.as_py(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()])], ["k", "bits"])

    made = ids.mapInArrow(local, "k int, bits binary").groupBy("k").applyInArrow(either, "k int, bits binary")
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in made.collect():
        out[r["k"] * step // 8 : (r["k"] + 1) * step // 8] = np.frombuffer(r["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def passing(ids: DataFrame) -> Callable[[Column], Column]:
    """Whether a number may be one of ``ids``, by a fixed-size filter; only the numbers go to Python."""
    sent = ids.sparkSession.sparkContext.broadcast(np.packbits(id_filter(ids)))

    @F.arrow_udf("boolean")
    def look_up(h: pa.Array) -> pa.Array:
        a, b = bits_of(h.to_numpy(zero_copy_only=False))
        bits = sent.value
        return pa.array((bits[a >> 3] >> (7 - (a & 7)) & bits[b >> 3] >> (7 - (b & 7)) & 1).astype(bool))

    return look_up


def fetched(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``h, body``: hashes of a row's id and text, and of its text) with ``text``.

    Rows are thinned out by a fixed-size filter where they are read; what passes is matched by the hash of its text.
    """
    found = docs.select(F.xxhash64("doc_id", "body").alias("h"), "body", "text").where(passing(wanted.select("h"))("h"))
    return found.groupBy("body").agg(F.any_value("text").alias("text")).join(wanted, "body")


def similar(shared: Column, a: Column, b: Column, percent: int) -> Column:
    return 100 * shared >= percent * (a + b - shared)


def in_groups(docs: DataFrame, brief: DataFrame, leads: DataFrame, members: DataFrame) -> DataFrame:
    """``g, part, lead, node, text``: groups (``g, node``), cut into parts, each after all leads of its group (``g, node, lead``; lead > 0)."""
    parts = members.groupBy("g").agg(((F.count(F.lit(1)) - 1) / PART).cast("int").alias("last"))
    each = members.join(parts, "g").select("g", "node", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int").alias("part"), F.lit(None).cast("int").alias("lead"))
    first = leads.join(parts, "g").select("g", "node", F.explode(F.sequence(F.lit(0), "last")).alias("part"), "lead")
    both = cut(each.unionByName(first).join(brief.select("node", "h", "body"), "node"))
    sent = fetched(docs, both).select("g", "part", "lead", "node", "text")
    return sent.repartition("g", "part").sortWithinPartitions("g", "part", F.col("lead").asc_nulls_last())


def runs(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bool, int, np.ndarray]]:
    """Group and part, whether it leads, node and set of each row."""
    for batch in batches:
        for start, stop in slices(pc.utf8_length(batch.column(4)).to_numpy(zero_copy_only=False), SLICE_CHARS):
            g, part, lead, node, text = (batch.column(i).slice(start, stop - start).to_pylist() for i in range(5))
            yield from zip(zip(g, part, strict=True), (x is not None for x in lead), node, token_sets(text, size), strict=True)


def packed(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def compared(docs: DataFrame, brief: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """``a, b, shared, na, nb`` of pairs of nodes, from their whole sets; each part of the pairs of one ``a`` gets its set once."""
    schema = pa.schema([(k, pa.int64()) for k in ("a", "b", "shared", "na", "nb")])

    def rows(batches):
        own = None
        for (a, _), leads, node, tokens in runs(size, batches):
            if leads:
                own = tokens
            else:
                yield a, node, len(np.intersect1d(own, tokens, True)), len(own), len(tokens)

    leads = pairs.select(F.col("a").alias("g"), F.col("a").alias("node"), F.lit(1).alias("lead")).distinct()
    sent = in_groups(docs, brief, leads, pairs.select(F.col("a").alias("g"), F.col("b").alias("node")))
    return sent.mapInArrow(lambda batches: packed(rows(batches), schema), "a long, b long, shared long, na long, nb long")


def centre(sample: list[np.ndarray]) -> np.ndarray:
    """What most of the sets near the first one have."""
    near = [x for x in sample if 2 * len(np.intersect1d(sample[0], x, True)) >= len(np.union1d(sample[0], x))] or sample[:1]
    tokens, counts = np.unique(np.concatenate(near), return_counts=True)
    return tokens[2 * counts > len(near)]


def differences(docs: DataFrame, brief: DataFrame, members: DataFrame, size: int, percent: int) -> DataFrame:
    """``g, node, n, w, inside, d``: size, weight, and difference from the centre of each member of the groups (``g, node``).

    ``d`` is null beyond the ring; ``inside`` if all similar sets are within it.
    """
    order = F.row_number().over(Window.partitionBy("g").orderBy(by_hash("node"), "node"))
    leads = members.withColumn("lead", order).where(F.col("lead") <= SAMPLE)
    schema = pa.schema([("g", pa.int64()), ("node", pa.int64()), ("n", pa.int64()), ("w", pa.int64()), ("inside", pa.bool_()), ("d", pa.list_(pa.int64()))])

    def rows(batches):
        key, sample, middle = None, [], None
        for at, leads, node, tokens in runs(size, batches):
            if at != key:
                key, sample, middle = at, [], None
            if leads:
                sample.append(tokens)
                continue
            if middle is None:
                middle = centre(sample)
            d = np.setxor1d(middle, tokens, True)
            either = (len(middle) + len(tokens) + len(d)) // 2
            near = 100 * len(d) <= RING * either
            yield at[0], node, len(tokens), (100 + percent) * len(d) - (100 - percent) * len(tokens), 100 * len(d) <= (RING - 100 + percent) * either, d if near else None

    return in_groups(docs, brief, leads, members).mapInArrow(lambda batches: packed(rows(batches), schema), "g long, node long, n long, w long, inside boolean, d array<long>")


def by_hash(node: str) -> Column:
    return F.xxhash64(F.col(node), F.lit(7))


def fits(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def apart() -> Column:
    """In how many bits the sketches of a pair differ: no more than the tokens in which the sets do. A longer one is folded."""
    x, y = F.col("sketchx"), F.col("sketchy")
    m = F.least(F.size(x), F.size(y))

    def folded(a: Column) -> Column:
        return F.when(F.size(a) > m, F.zip_with(F.slice(a, 1, m), F.slice(a, m + 1, m), lambda p, q: p.bitwiseXOR(q))).otherwise(a)

    bits = F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, c: n + c)
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * m, bits).otherwise(0)


def close(percent: int) -> Column:
    """Whether sets of sizes ``nx, ny`` with these sketches can be similar."""
    return fits(F.col("nx"), F.col("ny"), percent) & ((100 + percent) * apart() <= (100 - percent) * (F.col("nx") + F.col("ny")))


def sided(df: DataFrame, side: str, *keep: str) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(c + side) for c in df.columns if c not in keep])


def met(rows: DataFrame, percent: int, *same: str) -> DataFrame:
    """Pairs of rows (``node, n, own``) with equal ``same``; the smaller set has it in its shorter prefix."""
    x, y = sided(rows.where("own"), "x", *same), sided(rows, "y", *same)
    return x.join(y, list(same)).where(((F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("nodex") < F.col("nodey")))) & fits(F.col("nx"), F.col("ny"), percent))


def in_differences(near: DataFrame, best: DataFrame, part: DataFrame, brief: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links between components that tokens of the differences show."""
    s = 100 + percent
    tokens = near.select("g", "node", F.explode("d").alias("t"))
    twice = tokens.groupBy("g", "t").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rest = tokens.join(twice, ["g", "t"]).groupBy("g", "node").agg(F.sort_array(F.collect_list(F.struct("df", "t"))).alias("rest"))
    rows = near.select("g", "node", "n", "w").join(rest, ["g", "node"]).join(best.select("g", "wm"), "g")
    outer, r = F.col("w") + F.col("wm") > 0, F.size("rest").cast("long")
    rows = rows.where(2 * s * r >= F.when(outer, F.col("w") + F.col("wm")).otherwise(F.col("w") - F.col("wm")))
    rows = rows.join(part, "node", "left").withColumn("root", F.coalesce("root", "node")).join(brief.select("node", "sketch"), "node").withColumn("r", r)

    def keyed(least: Column) -> DataFrame:
        kept = F.slice("rest", 1, F.greatest(F.lit(0), F.col("r").cast("int") - F.greatest(F.lit(1), F.ceil(least).cast("int")) + 1))
        return rows.select("g", "node", "n", "w", "r", "root", "sketch", F.explode(F.transform(kept, lambda x: x["t"])).alias("t"), outer.alias("outer"))

    x = sided(keyed((F.col("w") + F.col("wm")) / (2 * s)).where("outer").drop("outer"), "x", "g", "t")
    y = sided(keyed(F.col("w") / s).drop("outer"), "y", "g", "t")
    later = (F.col("wy") < F.col("wx")) | ((F.col("wy") == F.col("wx")) & (F.col("nodey") < F.col("nodex")))
    pairs = x.join(y, ["g", "t"]).where(later & (F.col("rootx") != F.col("rooty")) & (2 * s * F.least("rx", "ry") >= F.col("wx") + F.col("wy")) & close(percent))
    pairs = cut(pairs.select("g", "nodex", "nodey").distinct())
    ends = near.select("g", "node", "w", "d")
    full = pairs.join(sided(ends, "x", "g"), ["g", "nodex"]).join(sided(ends, "y", "g"), ["g", "nodey"])
    return full.where(2 * s * F.size(F.array_intersect("dx", "dy")) >= F.col("wx") + F.col("wy")).select(F.col("nodex").alias("u"), F.col("nodey").alias("v"))


def jaccard_join(docs: DataFrame, size: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, root, body`` of every row; links are pairs of sets with Jaccard index >= percent / 100.

    ``root`` names the component by a node and ``body`` is the hash of the text; ``doc_id`` is the column ``key``.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("body"))
    full = cut(map_texts(docs, partial(_sets, size, percent), "node long, n int, region array<long>, sketch array<long>", ["doc_id", "body"], "text"))
    rows = cut(full.select("doc_id", "body", "node", "n"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")).alias("row")
    nodes = cut(full.where("n > 0").groupBy("node").agg(one, F.any_value("n").alias("n"), F.any_value("region").alias("region"), F.any_value("sketch").alias("sketch")))
    drop(full)
    brief = cut(nodes.select("node", F.col("row.doc_id").alias("id"), "row.body", F.xxhash64("row.doc_id", "row.body").alias("h"), "n", "sketch"))

    # the order: tokens that many sets have go last
    often = nodes.select("region").mapInArrow(_common, "token long, count long").groupBy("token").agg(F.sum("count").alias("c")).where(F.col("c") >= COMMON)
    common = np.sort(np.array([r[0] for r in often.orderBy(F.desc("c"), "token").limit(MOST_COMMON).select("token").collect()], np.int64))
    known = spark.sparkContext.broadcast(common)
    prefixes = "node long, n int, tokens array<long>, light int"
    first = nodes.select("node", "n", "region").mapInArrow(lambda b: _prefixes(known.value, percent, b), prefixes)
    # sets of many common tokens: from their whole texts
    wide = fetched(docs, cut(first.where("tokens IS NULL").select("node").join(brief.select("node", "h", "body"), "node"))).select("node", "text")

    def whole(batches):
        for batch in batches:
            for start, stop in slices(pc.utf8_length(batch.column(1)).to_numpy(zero_copy_only=False), SLICE_CHARS):
                sets = token_sets(batch.column(1).slice(start, stop - start).to_pylist(), size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array([len(t) for t in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["node", "n", "region"])

    both = cut(first.where("tokens IS NOT NULL").unionByName(wide.mapInArrow(lambda b: _prefixes(known.value, percent, whole(b)), prefixes)))
    drop(nodes)
    each = both.select("node", "n", "light", F.posexplode("tokens").alias("pos", "token"))
    # the common tokens, which alone can be hot, are counted in two steps
    by_token = each.where("pos < light").drop("light").repartition("token")
    rare = by_token.selectExpr("node", "n", "pos", "token", "count(1) OVER (PARTITION BY token) AS df").where("df > 1")
    dense = each.where("pos >= light").drop("light")
    counted = dense.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = cut(rare.unionByName(dense.join(counted, "token").select("node", "n", "pos", "token", "df")))
    drop(both)

    # each set's l: the least estimated number of candidates
    need = F.expr(f"({percent} * n + 99) DIV 100").cast("int")
    p = F.col("n") - need + 1
    costs = [F.when(need >= m, F.sum(F.when(F.col("pos") < p + (m - 1), F.least(F.col("df") - 1, F.lit(COMMON))).otherwise(0)) / float(m)) for m in range(1, LONGEST_L + 1)]
    best = shared.groupBy("node", "n").agg(F.array(*costs).alias("cost")).select("node", F.array_position("cost", F.array_min("cost")).cast("int").alias("l"))
    # the smaller of two similar sets shares so many tokens that a shorter prefix of it does
    own = F.col("pos") < F.col("n") - F.expr(f"({2 * percent} * n + {99 + percent}) DIV {100 + percent}").cast("int") + F.col("l")
    probes = cut(shared.join(best, "node").where(F.col("pos") < p + F.col("l") - 1).select("node", "n", "token", "l", "df", own.alias("own")))
    drop(shared)

    # light tokens: pairs that share l of them (or a heavy one, see below)
    x, y = (sided(brief.select("node", "n", "sketch"), s) for s in "xy")
    pairs = met(probes.where(F.col("df") <= COMMON).drop("df"), percent, "token").groupBy("nodex", "nodey").agg(F.count(F.lit(1)).alias("k"), F.min(F.least("lx", "ly")).alias("l")).where("k >= l")
    pairs = cut(pairs.select("nodex", "nodey").join(x, "nodex").join(y, "nodey").where(close(percent)).select("nodex", "nodey"))
    # heavy tokens: groups
    heavy = probes.where(F.col("df") > COMMON)
    leader = heavy.groupBy("token").agg(F.min_by("node", F.struct(by_hash("node"), "node")).alias("g"))
    led = cut(heavy.join(leader, "token").select("token", "g", "node", "n", "own"))
    members = cut(led.select("g", "node").distinct())
    drop(probes)

    around = pairs.unionAll(pairs.select("nodey", "nodex")).where(by_hash("nodey") < by_hash("nodex")).groupBy(F.col("nodex").alias("b")).agg(F.min_by("nodey", F.struct(by_hash("nodey"), "nodey")).alias("a"))
    star = cut(compared(docs, brief, cut(around.select("a", "b")), size))
    linked = star.where(similar(F.col("shared"), F.col("na"), F.col("nb"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    placed = cut(differences(docs, brief, members, size, percent))
    near = placed.where("d IS NOT NULL")
    middle = cut(near.groupBy("g").agg(F.min(F.struct("w", "node")).alias("m")).select("g", F.col("m.w").alias("wm"), F.col("m.node").alias("m")))
    around = near.join(middle, "g").where("w + wm <= 0 AND node <> m").select(F.col("node").alias("u"), F.col("m").alias("v"))
    part = cut(components(linked.unionAll(around)))

    # what is left: pairs of different components
    done = star.select(F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"))
    left = pairs.select(F.least("nodex", "nodey").alias("p"), F.greatest("nodex", "nodey").alias("q")).join(done, ["p", "q"], "left_anti")
    outside = led.join(placed.where("NOT inside").select("g", "node"), ["g", "node"]).select("token", "node", "n", "own")
    beyond = met(outside.join(part, "node", "left").join(brief.select("node", "sketch"), "node").withColumn("root", F.coalesce("root", "node")), percent, "token").where((F.col("rootx") != F.col("rooty")) & close(percent))
    left = left.unionAll(beyond.select(F.least("nodex", "nodey").alias("p"), F.greatest("nodex", "nodey").alias("q"))).distinct()
    rx, ry = part.select(F.col("node").alias("p"), F.col("root").alias("rp")), part.select(F.col("node").alias("q"), F.col("root").alias("rq"))
    left = left.join(rx, "p", "left").join(ry, "q", "left").where(F.coalesce("rp", "p") != F.coalesce("rq", "q"))
    last = compared(docs, brief, cut(left.select(F.col("p").alias("a"), F.col("q").alias("b"))), size)
    last = last.where(similar(F.col("shared"), F.col("na"), F.col("nb"), percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))
    last = cut(last.unionAll(in_differences(near, middle, part, brief, percent)))
    tied = last.join(part.select(F.col("node").alias("u"), F.col("root").alias("ru")), "u", "left").join(part.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v", "left")
    above = cut(components(tied.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))))
    drop(placed, led, members, pairs)

    named = brief.select("node", "id").join(part, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = named.join(above.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", "id", F.coalesce("top", "root").alias("root"))
    names = named.groupBy("root").agg(F.min("id").alias("component_id"))
    label = named.join(names, "root").select("node", "root", "component_id")
    out = rows.select("doc_id", "body", "node", F.col("n").cast("long").alias("n_shingles")).join(label, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "root", "body")


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row with the smallest id stays, and every row with an empty set.

    Rows that differ in neither id nor text count as one; of them the one with the least hash of its columns stays. Only rows that
    may go are shuffled: those that pass a fixed-size filter of what goes.
    """
    found = cut(jaccard_join(docs, size, percent, key, text).select("doc_id", "body", "n_shingles", "root"))
    ranked = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "body")
    best = found.where("n_shingles > 0").groupBy("root").agg(F.min(ranked).alias("best"))
    each = found.where("n_shingles > 0").groupBy("root", "doc_id", "body").agg(F.count(F.lit(1)).alias("rows"))
    each = each.join(best, "root").select(F.xxhash64("doc_id", "body").alias("h"), (ranked == F.col("best")).alias("stays"), "rows")
    going = cut(each.where("NOT stays OR rows > 1").select("h", "stays"))
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(f"`{key}`"), F.xxhash64(F.col(f"`{text}`"))).alias("h"))
    hashed = hashed.withColumn("maybe", passing(going.select("h"))("h"))
    some = hashed.where("maybe").join(going, "h", "left")
    unharmed = hashed.where("NOT maybe").select("row").unionAll(some.where("stays IS NULL").select("row"))
    again = some.where("stays").groupBy("h").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return unharmed.unionAll(again.select("row")).select("row.*")
