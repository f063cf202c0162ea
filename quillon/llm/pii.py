"""PII: high-recall generators, gradient boosted trees over format and context, calibrated thresholds.

All on the rows' path is DataFrame functions: patterns give candidate spans, their features are expressions, and the
trees are CASE expressions. Base kinds (mail, ip, card and phone patterns with their checks) are reported as they are.
Wider generators propose further candidates (phone numbers without a plus, grouped national ids, account numbers,
spelled-out mail addresses), which overlap each other and the base spans; the boosted trees score them, and those
past a threshold are reported. The threshold comes from held-out examples: the lowest score at which the asked
precision holds.

The trees are trained on the driver, on EXAMPLES generated sentences (a bound, whatever the tables' size); their features
come from the same expressions as the rows'.

Patterns are written so that no text takes more than linear time: runs are taken whole (possessive) and a start inside
a run that has failed isn't tried again. Places are sums over blocks of matches, a candidate's surroundings come from the gaps
beside it, and base spans that it touches are found by halving, so a text of very many matches takes little more than that, too.

Edge cases: a null text is taken as empty; equal rows give equal rows; extra columns are ignored; an empty table gives an
empty table; digits in runs longer than any kind are no candidates.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("local_phone", "national_id", "account", "spelled_email")
# The patterns of the base kinds, with runs taken whole.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]*[\x20().0-9-][0-9]",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z.-])[0-9]{3}[-\x20][0-9]{2}[-\x20][0-9]{4}(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,40}\x20?[\[(]?\x20?(?:at|AT)\x20?[\])]?\x20[A-Za-z0-9-]{2,40}\x20?[\[(]?\x20?(?:dot|DOT)\x20?[\])]?\x20?[A-Za-z]{2,6}(?![A-Za-z0-9])",
}
#: A sign without which a kind can't occur; texts without it skip its pattern.
NEEDS = {"email": "@", "phone": "+", "spelled_email": "(?i)dot"}
BEFORE, AFTER = 32, 8
#: Matches summed at once, and signs that a long text is cut into.
BLOCK, CHUNK = 128, 1024
#: Training sentences, trees, share of held-out sentences, and the precision asked of them.
EXAMPLES, TREES, RATE, HELD_OUT, PRECISION = 4000, 40, 0.3, 0.3, 0.99


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, not at each use."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, most: bool = False) -> Column:
    """For each of an array of integers the sum (or the most, 0 at least) of those before it.

    An array that grows by one is copied each time, so blocks of BLOCK are summed first: each element costs a block at most.
    """

    def over(part: Column) -> Column:
        return F.aggregate(part, F.lit(0), lambda acc, x: F.greatest(acc, x) if most else acc + x)

    def both(x: Column, y: Column) -> Column:
        return F.greatest(x, y) if most else x + y

    def all_of(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: over(F.slice(v, b * BLOCK + 1, F.lit(BLOCK))))
        before = let(totals, lambda t: F.transform(t, lambda _, b: over(F.slice(t, F.lit(1), b))))
        return let(before, lambda t: F.transform(v, lambda _, i: both(t[(i / BLOCK).cast("int")], over(F.slice(v, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))))

    return let(values, lambda v: F.when(F.size(v) > 0, all_of(v)).otherwise(F.array().cast("array<int>")))


def last(text: Column, n: int) -> Column:
    """At most the last ``n`` signs."""
    return F.when(F.length(text) > n, F.substring(text, -n, n)).otherwise(text)


def found(text: Column, kind: str) -> Column:
    """The matches of a kind in order, with start and end in code points, and for wider kinds the signs before and after.

    The gaps between matches come from splitting by the same pattern; their lengths give the places, and they hold the signs
    around a match: three matches before it are longer than BEFORE, the next one is longer than AFTER.
    """
    shape = "kind:string,start:int,end:int,m:string" + (",before:string,after:string" if kind in MORE else "")
    none = F.array().cast(f"array<struct<{shape}>>")

    def placed(matches: Column, gaps: Column, starts: Column) -> Column:
        def each(m: Column, i: Column) -> Column:
            at = starts[i] + F.length(gaps[i])
            cols = [F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(m)).alias("end"), m.alias("m")]
            if kind in MORE:
                back = [F.when(i >= k, F.concat(last(gaps[i - k], BEFORE), matches[i - k])).otherwise(F.lit("")) for k in (3, 2, 1)]
                cols.append(last(F.concat(*back, last(gaps[i], BEFORE)), BEFORE).alias("before"))
                cols.append(F.substring(F.concat(F.substring(gaps[i + 1], 1, AFTER), F.coalesce(F.get(matches, i + 1), F.lit(""))), 1, AFTER).alias("after"))
            return F.struct(*cols)

        return F.transform(matches, each)

    def located(matches: Column) -> Column:
        def with_gaps(gaps: Column) -> Column:
            steps = F.transform(matches, lambda m, i: F.length(gaps[i]) + F.length(m))
            return let(running(steps), lambda starts: placed(matches, gaps, starts))

        return F.when(F.size(matches) > 0, let(F.split(text, PATTERNS[kind], -1), with_gaps)).otherwise(none)

    need = F.contains(text, F.lit(NEEDS[kind])) if len(NEEDS.get(kind, "long")) == 1 else F.rlike(text, F.lit(NEEDS.get(kind, "[0-9]")))
    return F.when(need, let(F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), located)).otherwise(none)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the check sum; every second from the right counts doubled, less 9 if over 9."""
    n = F.length(number)

    def value(i: Column) -> Column:
        d = F.substring(number, i, 1).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.coalesce(value(i), F.lit(0)))
    return total % 10 == 0


def part_ok(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(short) <= 3, short.cast("int") <= 255).otherwise(F.lit(False))


VALID = {
    "email": lambda x: F.lit(True),
    "ip": lambda x: F.forall(F.split(x["m"], "[.]"), part_ok),
    "card": lambda x: F.when(F.length(digits(x["m"])).between(13, 19), luhn(digits(x["m"]))).otherwise(F.lit(False)),
    "phone": lambda x: F.length(digits(x["m"])).between(9, 15),
}

WORDS = {
    "phone_word": r"(?i)(?:phone|mobile|cell|call|fax|tel|dial|contact|reach|whatsapp|rufnummer|tel[eé]fono|t[eé]l[eé]phone)",
    "id_word": r"(?i)(?:ssn|social security|tax id|national id|passport|insurance no|tin)\b",
    "bank_word": r"(?i)(?:iban|account|bank|transfer|konto|compte|cuenta)",
    "mail_word": r"(?i)(?:e-?mail|write|contact|reach|mailto|send)",
    "number_word": r"(?i)(?:order|part|item|version|isbn|invoice|serial|ticket|model|build|page|sku|ref)",
}


def features(x: Column) -> list[Column]:
    """Numbers of a candidate: its form, and the signs and words around it."""
    before, after, m = x["before"], x["after"], x["m"]
    flag = lambda c: c.cast("double")
    return [
        *[flag(x["kind"] == k) for k in MORE],
        *[flag(F.rlike(before, F.lit(w))) for w in WORDS.values()],
        F.length(digits(m)).cast("double"),
        F.length(m).cast("double"),
        flag(F.contains(m, F.lit("("))),
        flag(F.contains(m, F.lit("."))),
        flag(F.contains(m, F.lit("-"))),
        flag(F.rlike(before, F.lit(r"[:=]\s*$"))),
        flag(F.rlike(before, F.lit(r"[#$€£]\s*$"))),
        flag(F.rlike(after, F.lit(r"^\s*(?:%|[A-Za-z]{2,3}\b)"))),
    ]


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """``id, text, label``: sentences with one candidate, personal or not."""

    def pick(salt: str, of: list[str]) -> Column:
        return F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(of))) + 1).cast("int"))

    def num(salt: str, k: int) -> Column:
        return F.lpad(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**k)).cast("string"), k, "0")

    a, b, c, d = num("a", 3), num("b", 3), num("c", 4), num("d", 2)
    sep = pick("sep", ["-", " ", "."])
    account = F.concat(pick("land", ["DE", "FR", "ES", "GB"]), d, F.lit(" "), c, F.lit(" "), num("e", 4), F.lit(" "), num("f", 4), F.lit(" "), num("g", 4))
    mail = F.concat(pick("name", ["ann.lee", "jo77", "m_rossi", "sam"]), pick("at", [" at ", " [at] ", " (at) "]), pick("host", ["mail", "example", "post-box"]), pick("dot", [" dot ", " [dot] "]), pick("top", ["com", "org", "net"]))
    forms = [F.concat(F.lit("("), a, F.lit(") "), b, sep, c), F.concat(a, sep, b, sep, c), F.concat(a, F.lit("-"), d, F.lit("-"), c), account, mail]
    personal = [["call ", "phone: ", "Tel. ", "reach me on ", "mobile ", "fax: "]] * 2 + [["SSN ", "social security ", "tax id: ", "passport "], ["IBAN ", "bank account: ", "transfer to ", "Konto "], ["email ", "write to ", "contact ", "e-mail: "]]
    plain = [["order ", "part ", "version ", "ref ", "the ", "of ", "serial ", "and ", "in "]] * 4 + [["look ", "we met ", "page ", "stand ", "the "]]
    label = F.pmod(F.xxhash64("id", F.lit("label")), F.lit(2))
    form = F.pmod(F.xxhash64("id", F.lit("form")), F.lit(len(forms)))
    text = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        lead = F.when(label == 1, pick("p", personal[i])).otherwise(pick("q", plain[i]))
        text = F.when(form == i, F.concat(pick("open", ["", "Please ", "on monday ", "as it was, "]), lead, f, pick("close", [".", " today.", ", thanks", " and so on"]))).otherwise(text)
    return spark.range(n).select("id", text.alias("text"), label.cast("int").alias("label"))


def tree(x: np.ndarray, grad: np.ndarray, weight: np.ndarray, depth: int = 2) -> tuple:
    """A regression tree (feature, cut, left, right), or a leaf's value, by Newton steps."""
    total = grad.sum() / (weight.sum() + 1.0)
    if not depth or len(x) < 20:
        return (float(total),)
    best = (1e-6, None, None)
    score = lambda g, h: g * g / (h + 1.0)
    for j in range(x.shape[1]):
        for cut in np.unique(x[:, j])[:-1]:
            left = x[:, j] <= cut
            gain = score(grad[left].sum(), weight[left].sum()) + score(grad[~left].sum(), weight[~left].sum()) - score(grad.sum(), weight.sum())
            if gain > best[0]:
                best = (gain, j, cut)
    if best[1] is None:
        return (float(total),)
    left = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), tree(x[left], grad[left], weight[left], depth - 1), tree(x[~left], grad[~left], weight[~left], depth - 1))


def value(t: tuple, x: np.ndarray) -> np.ndarray:
    if len(t) == 1:
        return np.full(len(x), t[0])
    return np.where(x[:, t[0]] <= t[1], value(t[2], x), value(t[3], x))


@lru_cache(maxsize=1)
def trained_on(rows: tuple) -> tuple[tuple, dict[str, float]]:
    """Trees, and a threshold of the summed trees for each kind, from rows of label and features."""
    data = np.array(rows, float)
    y, x = data[:, 0], data[:, 1:]
    held = np.arange(len(y)) % 10 < 10 * HELD_OUT
    f, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        t = tree(x[~held], (y - p)[~held], (p * (1 - p))[~held])
        trees.append(t)
        f += RATE * value(t, x)
    at = {}
    for i, kind in enumerate(MORE):
        own = held & (x[:, i] == 1)
        order = np.argsort(-f[own], kind="stable")
        s, hit = f[own][order], y[own][order]
        precision = np.cumsum(hit) / np.arange(1, len(hit) + 1)
        ok = [k for k in range(len(s)) if precision[k] >= PRECISION and (k + 1 == len(s) or s[k + 1] < s[k])]
        at[kind] = float(s[ok[-1]]) - 1e-9 if ok else float("inf")
    return tuple(trees), at


def train(spark: SparkSession) -> tuple[tuple, dict[str, float]]:
    made = candidates(examples(spark)).select("id", "label", F.explode("found.more").alias("x")).select("id", "label", F.array(*features(F.col("x"))).alias("f"))
    return trained_on(tuple((r["label"], *r["f"]) for r in made.orderBy("id", "f").collect()))


def candidates(docs: DataFrame, text: str = "text", into: str = "found") -> DataFrame:
    """``docs`` with a struct of ``base`` (for each kind its checked matches) and ``more`` (not yet scored)."""
    t = F.coalesce(F.col(text), F.lit(""))
    base = F.struct(*[F.filter(found(t, k), VALID[k]).alias(k) for k in BASE])
    return docs.withColumn(into, F.struct(base.alias("base"), F.concat(*[found(t, k) for k in MORE]).alias("more")))


def expression(t: tuple, f: Column) -> Column:
    if len(t) == 1:
        return F.lit(t[0])
    return F.when(f[t[0]] <= t[1], expression(t[2], f)).otherwise(expression(t[3], f))


def touches(spans: Column, x: Column) -> Column:
    """Whether one of the spans (disjoint, by start) has a sign of ``x``: the last that starts before the end of ``x``, if any.

    Few are looked through; of many that one is found by halving.
    """

    def halve(bounds: Column, _: Column) -> Column:
        mid = F.shiftright(bounds["low"] + bounds["high"], 1)
        below = spans[mid]["start"] < x["end"]
        open_ = bounds["low"] < bounds["high"]
        return F.struct(F.when(open_ & below, mid + 1).otherwise(bounds["low"]).alias("low"), F.when(open_ & ~below, mid).otherwise(bounds["high"]).alias("high"))

    n = F.aggregate(F.sequence(F.lit(1), F.lit(31)), F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda b: b["low"])
    many = let(n, lambda i: F.when(i > 0, spans[i - 1]["end"] > x["start"]).otherwise(F.lit(False)))
    return F.when(F.size(spans) <= 24, F.exists(spans, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))).otherwise(many)


def selected(rows: DataFrame, trees: tuple, at: dict[str, float], found_: str = "found", into: str = "spans") -> DataFrame:
    """``rows`` with the spans: the base spans, and the candidates past their kind's threshold that touch none of them."""

    def passes(x: Column) -> Column:
        scored = F.aggregate(F.array(F.array(*features(x))), F.lit(0.0), lambda s, f: s + sum((RATE * expression(t, f) for t in trees), F.lit(0.0)))
        limit = F.element_at(F.create_map(*[v for k, s in at.items() for v in (F.lit(k), F.lit(s))]), x["kind"])
        return scored >= limit

    def slim(spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    def of(c: Column) -> Column:
        def apart(x: Column) -> Column:
            out = F.lit(True)
            for k in BASE:
                out = out & ~touches(c["base"][k], x)
            return out

        more = F.when(F.size(c["more"]) > 0, F.filter(c["more"], lambda x: apart(x) & passes(x))).otherwise(c["more"])
        return F.concat(*[slim(c["base"][k]) for k in BASE], slim(more))

    return rows.withColumn(into, let(F.col(found_), of))


def personal_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None, into: str = "spans") -> DataFrame:
    """The kept columns (all but the text by default; none may be named like ``into``) and the spans: array of kind, start, end by kind and then start."""
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    trees, at = train(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in keep]
    slim = docs.select(F.struct(*kept, F.lit(0).alias("__none")).alias("kept"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    out = selected(candidates(slim), trees, at)
    return out.select(*[F.col("kept").getField(c).alias(c) for c in keep], F.col("spans").alias(into))


def cut_out(chunks: Column, start: Column, end: Column) -> Column:
    """The signs from ``start`` to ``end`` of a text in chunks of CHUNK signs."""

    def parts(a: Column, b: Column) -> Column:
        inside = F.substring(chunks[a], start % CHUNK + 1, end - start)
        across = F.concat(F.substring(chunks[a], start % CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, a + 2, b - a - 1), ""), F.substring(F.coalesce(F.get(chunks, b), F.lit("")), F.lit(1), end % CHUNK))
        return F.when(a == b, inside).otherwise(across)

    return F.when(start < end, parts((start / CHUNK).cast("int"), (end / CHUNK).cast("int"))).otherwise(F.lit(""))


def redacted(text: Column, spans: Column) -> Column:
    """A text with its spans, overlapping ones as one, replaced by the name of their first kind."""

    def done(chunks: Column) -> Column:
        order = F.sort_array(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

        def pieces(xs: Column) -> Column:
            def piece(reached: Column) -> Column:
                names = F.transform(xs, lambda x, i: F.when((x["start"] < reached[i]), F.lit("")).otherwise(F.concat(cut_out(chunks, reached[i], x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))))
                end = F.greatest(reached[F.size(xs) - 1], xs[F.size(xs) - 1]["end"])
                return F.concat(F.array_join(names, ""), cut_out(chunks, end, F.length(text)))

            return let(running(F.transform(xs, lambda x: x["end"]), True), piece)

        return let(order, pieces)

    return F.when(F.size(spans) > 0, let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)), done)).otherwise(text)


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest(found_: DataFrame) -> DataFrame:
    """The counts of the base kinds, SHA-256 of the base spans, and all spans as text."""
    joined = lambda s: F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in (*BASE, *MORE)]
    return found_.select("doc_id", *counts, F.sha2(joined(F.filter("spans", lambda x: x["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
