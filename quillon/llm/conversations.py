"""Repair of conversations' structure: the cheapest edits after which the roles' initials read ``(s?(ua)+)?``.

A forward Viterbi pass over four grammar states (nothing yet, after s, after u, after a). Every layer holds for each state the least (cost,
audit), the audit being the edits' initials so far; a row's edits lead to the next layer, which then is closed under inserts (two at most: start
to u to a). Two audits of one cost over the same rows never begin one another, so the least of each state is enough.

A conversation is cut into chunks of so many turns, so that one of very many rows is many keys: a chunk's pass is run from each of the states
it may be entered in, chunks are put together by (min, +) products in their order, and the winning audit is handed back to the chunks, which
write their repaired rows. A task holds one chunk of rows, and of a whole conversation its audit alone.

Edge cases: null roles and texts are one space; of rows of one turn the order is by role, then text, by code points; rows without a turn come
first; rows of one turn stay in one chunk, however many; a null id is a conversation like another; empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Costs: a new role or an inserted row, a row deleted, a truncated row kept.
CHANGE, DELETE, TRUNCATED = 3, 4, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: From a state by an initial to a state, and where a conversation may end.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
ENDS = (START, ASSISTANT)
LEGAL = ("su", "ua", "au")
#: Turns of a chunk.
TURNS = 256
Layer = list[tuple[int, str] | None]


def role_after(state: int) -> tuple[str, int]:
    """What a new or changed row becomes behind a state, and the state behind it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def closed(layer: Layer) -> Layer:
    """The layer with what inserts add: to u from everywhere, then to a from u."""
    for states, to in (((START, SYSTEM, ASSISTANT), USER), ((USER,), ASSISTANT)):
        for s in states:
            if (at := layer[s]) and (layer[to] is None or (at[0] + CHANGE, at[1] + "I") < layer[to]):
                layer[to] = (at[0] + CHANGE, at[1] + "I")
    return layer


def passed(layer: Layer, initial: str, fault: str) -> Layer:
    """The layer behind a row: kept, given a role, or deleted; blank (b) and duplicate (d) rows can only be deleted."""
    out: Layer = [at and (at[0] + DELETE, at[1] + "D") for at in layer]
    if fault not in ("b", "d"):
        more = TRUNCATED if fault == "t" else 0
        for s, at in enumerate(layer):
            if at is None:
                continue
            for to, cost, edit in ((NEXT.get((s, initial)), more, "K"), (role_after(s)[1], more + CHANGE, "R")):
                if to is not None and (out[to] is None or (at[0] + cost, at[1] + edit) < out[to]):
                    out[to] = (at[0] + cost, at[1] + edit)
    return closed(out)


def fault_of(role: str, text: str, seen: bool) -> str:
    """``b`` blank, ``d`` duplicate, ``t`` truncated or nothing; the first that applies."""
    end = text.rstrip(" \t\n\v\f\r")
    if not end:
        return "b"
    return "d" if seen else "" if end[-1] in ".!?" else "t"


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: the rows (nulls: one space) with faults by ``crc32("conv_id:turn") % 20``: 0 drops a row (no copies),
    1 empties its text, 2 takes ``. ! ?`` out of it, 3 repeats it, 4 makes its role user."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text, role = or_space("text"), or_space("role")
    text = F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.when(k == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(k == 0, 0).when(k == 3, 2).otherwise(1).alias("copies"))


CHUNK = "conv_id {kind}, chunk long, roles array<string>, texts array<string>, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"


def chunked(rows: DataFrame) -> DataFrame:
    """A row for each chunk of a conversation: its rows in order, counts of faults, and for each pair of states the least cost and audit between them.

    Rows ``conv_id, turn, role, text, copies``. Texts seen in an earlier turn are found by sums over their hashes; those of one turn
    are neighbours in the chunk.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    block = F.coalesce(F.floor(F.col("turn") / TURNS).cast("long"), F.lit(-(2**62)).cast("long"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("chunk", block)
    when = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    # only texts of several turns are joined back; of a turn with no number, all are in one chunk
    again = rows.where("copies > 0").groupBy("conv_id", "role", "digest").agg(F.min(when).alias("since"), F.max(when).alias("until")).where("since <> until")
    again = again.select(F.col("conv_id").alias("__c"), F.col("role").alias("__r"), F.col("digest").alias("__d"), "since")
    told = rows.join(again, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("role") == F.col("__r")) & (F.col("digest") == F.col("__d")), "left")
    told = told.withColumn("seen", F.coalesce(when > F.col("since"), F.lit(False)))
    ordered = told.select("conv_id", "chunk", "turn", "role", "text", "copies", "seen").repartition("conv_id", "chunk").sortWithinPartitions("conv_id", "chunk", "turn", "role", "text")

    def summary(key: tuple, part: list[tuple]) -> tuple:
        """Of the rows (turn, role, text, copies, seen) of a chunk, in order."""
        roles, texts, count = [], [], {"b": 0, "d": 0, "t": 0, "": 0}
        layers: list[Layer] = [[(0, "") if s == entry else None for s in range(4)] for entry in range(4)]
        illegal, turns, before = 0, set(), None
        for turn, role, text, copies, seen in part:
            for _ in range(copies):
                fault = fault_of(role, text, seen or before == (turn, role, text))
                count[fault] += 1
                if roles and roles[-1][:1] + role[:1] not in LEGAL:
                    illegal += 1
                before = (turn, role, text)
                roles.append(role)
                texts.append(text)
                turns.add(turn)
                layers = [passed(layer, role[:1], fault) for layer in layers]
        turns.discard(None)
        costs = [at and at[0] for layer in layers for at in layer]
        audits = [at and at[1] for layer in layers for at in layer]
        ends = (roles[0][:1], roles[-1][:1]) if roles else (None, None)
        return (*key, roles, texts, len(roles), count["b"], count["d"], count["t"], illegal, *ends, min(turns, default=None), max(turns, default=None), len(turns), costs, audits)

    return ordered.mapInArrow(_runs(2, summary, CHUNK.format(kind=kind)), CHUNK.format(kind=kind))


def _runs(keys: int, work, schema: str, batch_rows: int = 512, batch_chars: int = 4_000_000):
    """A function for ``mapInArrow`` that hands each run of rows with equal first columns to ``work``, which gives a tuple; batches of what it gives are bounded."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    names, types = [f.name for f in fields], [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        key, part, out, held = None, [], [], 0
        for batch in batches:
            for start in range(0, len(batch), 256):  # a slice of rows at a time becomes Python objects
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if part and row[:keys] != key:
                        out.append(work(key, part))
                        held += sum(len(x) for r in part for x in r if isinstance(x, str))
                        part = []
                        if len(out) >= batch_rows or held >= batch_chars:
                            yield packed(out)
                            out, held = [], 0
                    key = row[:keys]
                    part.append(row[keys:])
        if part:
            out.append(work(key, part))
        if out:
            yield packed(out)

    return run


PLAN = "conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, parts array<struct<chunk: long, state: int, edits: string>>"


def planned(chunks: DataFrame) -> DataFrame:
    """A row for each conversation: its counts, the least cost, the audit, and of each chunk the state it is entered in and its edits. No texts are read."""
    kind = chunks.schema["conv_id"].dataType.simpleString()

    def plan(key: tuple, part: list[tuple]) -> tuple:
        sums, illegal, last, low, high, turns = [0, 0, 0], 0, None, None, None, 0
        # of each state: cost, audit, and the chunks' entries so far as a chain (before, chunk, state, length of the audit there)
        layer: list[tuple[int, str, tuple | None] | None] = [(0, "", None), None, (CHANGE, "I", None), (2 * CHANGE, "II", None)]
        for chunk, n, blank, duplicate, truncated, inner, first, end, lowest, highest, count, costs, audits in part:
            sums = [a + b for a, b in zip(sums, (blank, duplicate, truncated), strict=True)]
            illegal += inner + (last is not None and first is not None and last + first not in LEGAL)
            last = end if n else last
            low = min((x for x in (low, lowest) if x is not None), default=None)
            high = max((x for x in (high, highest) if x is not None), default=None)
            turns += count
            after: list = [None] * 4
            for s, at in enumerate(layer):
                for to in range(4):
                    if at and costs[4 * s + to] is not None:
                        new = (at[0] + costs[4 * s + to], at[1] + audits[4 * s + to])
                        if after[to] is None or new < after[to][:2]:
                            after[to] = (*new, (at[2], chunk, s, len(at[1])))
            layer = after
        cost, audit, chain = min((layer[s] for s in ENDS if layer[s]), key=lambda x: x[:2])
        parts, end = [], len(audit)
        while chain:
            chain, chunk, state, begin = chain
            parts.append({"chunk": chunk, "state": state, "edits": audit[begin:end]})
            end = begin
        if parts and end:  # inserts before the first row
            parts[-1] |= {"state": START, "edits": audit[:end] + parts[-1]["edits"]}
        gaps = high - low + 1 - turns if turns else 0
        return (*key, gaps, *sums, illegal, cost, audit, parts[::-1])

    narrow = chunks.select("conv_id", "chunk", "n", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "costs", "audits")
    return narrow.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_runs(1, plan, PLAN.format(kind=kind)), PLAN.format(kind=kind))


def edited(roles: list[str], texts: list[str], state: int, edits: str) -> list[tuple[str, str]]:
    """The rows that edits leave of rows, entered in a state."""
    out, i = [], 0
    for edit in edits:
        if edit != "I":
            role, text = roles[i], texts[i]
            i += 1
            if edit == "D":
                continue
        if edit == "K":
            state = NEXT[state, role[:1]]
        else:
            role, state = role_after(state)
            text = "" if edit == "I" else text
        out.append((role, text))
    return out


def repaired(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The plans of conversations (see ``planned``), and their repaired rows ``conv_id, chunk, roles, texts``, an array for each chunk, of rows ``conv_id, turn, role, text, copies``."""
    chunks = cut(chunked(rows))
    plans = cut(planned(chunks))
    parts = plans.select(F.col("conv_id").alias("__c"), F.explode("parts").alias("p")).select("__c", F.col("p.chunk").alias("__k"), "p.state", "p.edits")
    with_edits = chunks.select("conv_id", "chunk", "roles", "texts").join(parts, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__k"))).select("conv_id", "chunk", "roles", "texts", "state", "edits")
    kind = rows.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 16):
                some = batch.slice(i, 16)
                found = [edited(*row) for row in zip(*(some.column(c).to_pylist() for c in range(2, 6)), strict=True)]
                sides = [pa.array([[x[k] for x in f] for f in found], pa.list_(pa.string())) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), *sides], ["conv_id", "chunk", "roles", "texts"])

    return plans, with_edits.mapInArrow(work, f"conv_id {kind}, chunk long, roles array<string>, texts array<string>")


def digests(rows: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of repaired rows; a conversation's rows go through one task in order, a batch at a time, as the digest of their joined lines asks."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(ids: list, found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, types[0]), pa.array(found, pa.string())], ["conv_id", "repaired_sha256"])

        key, state, empty, ids, found, types = (), None, True, [], [], []
        for batch in batches:
            types = [batch.schema.field(0).type]
            for i in range(0, len(batch), 16):
                some = batch.slice(i, 16)
                for conv, roles, texts in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True):
                    if key != (conv,):
                        if state:
                            ids.append(key[0])
                            found.append(state.hexdigest())
                        key, state, empty = (conv,), hashlib.sha256(), True
                    if roles:
                        state.update(("" if empty else "\n").encode() + "\n".join(f"{r}:{t}" for r, t in zip(roles, texts, strict=True)).encode())
                        empty = False
            if len(ids) >= 4096:
                yield told(ids, found)
                ids, found = [], []
        if state:
            yield told([*ids, key[0]], [*found, state.hexdigest()])

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def repair_report(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation of the table, damaged first."""
    plans, fixed = repaired(damaged(rows))
    shas = digests(fixed).select(F.col("conv_id").alias("__c"), "repaired_sha256")
    return plans.join(shas, F.col("conv_id").eqNullSafe(F.col("__c")), "left").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


_CRC = "xor(list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, length(key) + 1), lambda i: [ascii(key[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, e: xor(xor(c, e) >> 1, 3988292384 * (xor(c, e) & 1))), 4294967295)"
_VISIBLE = r"regexp_replace(text, '[\x20\x09-\x0D]+$', '')"


def _add(v: str, cost: str, letter: str) -> str:
    """SQL: a least (cost, audit), written as nine digits and the audit, one edit on."""
    return f"(printf('%09d', {v}[1:9]::INT + {cost}) || {v}[10:] || '{letter}')"


def _oracle() -> str:
    keep = lambda v, initial: f"CASE WHEN live AND ini = '{initial}' THEN {_add(v, 'more', 'K')} END"
    role = lambda v: f"CASE WHEN live THEN {_add(v, 'more + 3', 'R')} END"
    gone = lambda v: _add(v, "4", "D")
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, {_CRC} % 20 AS k FROM k),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
r AS (SELECT conv_id, turn, i, role, text, role[1] AS ini, before, CASE WHEN {_VISIBLE} = '' THEN 'b' WHEN seen THEN 'd' WHEN regexp_matches({_VISIBLE}, '[.!?]$') THEN '' ELSE 't' END AS fault FROM p),
q AS (SELECT conv_id, i, ini, fault NOT IN ('b', 'd') AS live, CASE fault WHEN 't' THEN 3 ELSE 0 END AS more FROM r),
ids AS (SELECT DISTINCT conv_id FROM conversations),
dp(conv_id, i, v0, v1, v2, v3) AS (SELECT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM ids
 UNION ALL SELECT conv_id, i, n0, n1, n2, least(n3, {_add('n2', '3', 'I')}) FROM (SELECT conv_id, i, n0, n1, least(n2, {_add('n0', '3', 'I')}, {_add('n1', '3', 'I')}, {_add('n3', '3', 'I')}) AS n2, n3 FROM
 (SELECT dp.conv_id, q.i, {gone('v0')} AS n0, least({gone('v1')}, {keep('v0', 's')}) AS n1, least({gone('v2')}, {', '.join(f(v) for v in ('v0', 'v1', 'v3') for f in (lambda v: keep(v, 'u'), role))}) AS n2, least({gone('v3')}, {keep('v2', 'a')}, {role('v2')}) AS n3
 FROM dp JOIN q ON q.conv_id IS NOT DISTINCT FROM dp.conv_id AND q.i = dp.i + 1))),
best AS (SELECT conv_id, least(v0, v3) AS v FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
plan AS (SELECT conv_id, v[1:9]::BIGINT AS cost, v[10:] AS audit FROM best),
e AS (SELECT conv_id, j, audit[j] AS edit, length(replace(audit[1:j], 'I', '')) AS i FROM plan, LATERAL (SELECT unnest(range(1, length(audit) + 1)) AS j)),
m AS (SELECT e.conv_id, e.j, e.edit, r.role, r.text, r.ini, row_number() OVER (PARTITION BY e.conv_id ORDER BY e.j) AS n, first_value(e.edit = 'K' AND r.ini = 's') OVER (PARTITION BY e.conv_id ORDER BY e.j) AS led FROM e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.i = e.i AND e.edit <> 'I' WHERE e.edit <> 'D'),
f AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS sha FROM m GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(fault = 'b')::BIGINT AS blank, count_if(fault = 'd')::BIGINT AS duplicate, count_if(fault = 't')::BIGINT AS truncated, count_if(i > 1 AND coalesce(before, '') || coalesce(ini, '') NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM r GROUP BY conv_id)
SELECT plan.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM plan LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM plan.conv_id LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM plan.conv_id"""


ORACLE_SQL = _oracle()
