"""Secret scans: strong patterns, and multipart credentials linked by an interval join.

Strong (base) spans are reported wherever they stand. Weak candidates are parts of a credential that mean little alone:
access identifiers (``user=``, ``client_id:``), secrets (a token of mixed signs and high entropy, ``pwd: hunter22``)
and endpoints (``https://…``, ``host=``). Within a scope (a block of lines without an empty line) each weak part is joined by
distance to the nearest parts of the complementary kinds, and reported only when one is in reach: an identifier or an
endpoint needs a secret, a weak secret needs an identifier or an endpoint. Strong access keys count as identifiers,
strong assignments as secrets. The parts of a text are sorted, so the join is a search for neighbours, not for pairs.

Edge cases: a null text is taken as empty; an empty text has no spans; equal rows give equal rows; extra columns are
ignored; an empty table gives an empty table; no pattern takes more than linear time over a run of its own signs.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BASE = ("assign", "access", "hex")
WEAK = ("weak_id", "weak_secret", "endpoint")
ORDER = {k: i for i, k in enumerate(BASE + WEAK)}

# The patterns of the strong kinds.
ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a shorter run fails at each of its starts
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12

IDENTIFIER = re.compile(r"(?<![A-Za-z0-9_])(?:user(?:_?name)?|login|account(?:_?id)?|client_?id|key_?id|access_?key(?:_?id)?|tenant(?:_?id)?)[\"']?[ \t]*+[:=][ \t]*+[\"']?([A-Za-z0-9._@+-]{3,})", re.I | re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:pwd|pass|pw|passphrase|credential|private_?key)[\"']?[ \t]*+[:=][ \t]*+[\"']?([^\s\"',;<>]{6,})", re.I | re.A)
LONG = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
ENDPOINT = re.compile(r"(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{3,}")
HOST = re.compile(r"(?<![A-Za-z0-9_])(?:host|hostname|server|endpoint|url|bucket)[\"']?[ \t]*+[:=][ \t]*+[\"']?([A-Za-z0-9.:/_-]{4,})", re.I | re.A)
EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")
#: How far apart parts may stand, in code points, and the least entropy of a lone secret, in bits a sign.
REACH, ENTROPY = 300, 3.6


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values())


def strong(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def lone_secrets(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    taken = sorted((s, e) for _, s, e in base)
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or furthest[i - 1] <= a

    def mixed(t: str) -> bool:
        return any(c.isdigit() for c in t) and any("A" <= c <= "Z" for c in t) and any("a" <= c <= "z" for c in t) and entropy(t) >= ENTROPY

    out = [("weak_secret", *m.span()) for m in LONG.finditer(text) if free(*m.span()) and mixed(m.group())]
    return out + [("weak_secret", *m.span(1)) for m in SECRET.finditer(text) if free(*m.span(1))]


def linked(text: str, base: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """The weak spans that a complementary part is in reach of, within their scope."""
    weak_secrets = lone_secrets(text, base)
    secrets = sorted({(s, e) for k, s, e in base if k == "assign"} | {(s, e) for _, s, e in weak_secrets})
    if not secrets:
        return []
    ids = [("weak_id", *m.span(1)) for m in IDENTIFIER.finditer(text)]
    ends = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)] if "://" in text else []
    ends += [("endpoint", *m.span(1)) for m in HOST.finditer(text)]
    others = sorted({(s, e) for k, s, e in base if k == "access"} | {(s, e) for _, s, e in ids + ends})
    if not others:
        return []
    breaks = [m.start() for m in EMPTY_LINE.finditer(text)]

    def bounds(parts: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        return sorted(a for a, _ in parts), sorted(b for _, b in parts)

    def near(span: tuple[int, int], starts: list[int], ends: list[int]) -> bool:
        """Interval join by sorted bounds: of the parts that end before the span the last end, of those that start after it the
        first start; no other is closer or in its scope without that one, as no part crosses an empty line.
        """
        i, j = bisect_right(ends, span[0]), bisect_left(starts, span[1])
        gaps = [(ends[i - 1], span[0])] if i else []
        gaps += [(span[1], starts[j])] if j < len(starts) else []
        return any(high - low <= reach and bisect_left(breaks, low) == bisect_left(breaks, high) for low, high in gaps)

    of_secrets, of_others = bounds(secrets), bounds(others)
    spans = {x for x in ids + ends if near(x[1:], *of_secrets)} | {x for x in weak_secrets if near(x[1:], *of_others)}
    return sorted(spans, key=lambda x: (x[1], ORDER[x[0]], x[2]))


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans, by start and then kind."""
    if not text:
        return []
    base = strong(text)
    return sorted(base + linked(text, base), key=lambda x: (x[1], ORDER[x[0]], x[2]))


def _work():
    return lambda texts: [([{"kind": k, "start": s, "end": e} for k, s, e in spans(x)],) for x in texts]


def secret_spans(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``spans``: array of kind, start, end (code points, end exclusive), by start and then kind."""
    return map_texts(docs, _work, "spans array<struct<kind:string,start:int,end:int>>", key, text)


def joined(spans_column):
    return F.array_join(F.transform(spans_column, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(kind: str):
    return lambda x: x["kind"] == kind


def digest(found: DataFrame) -> DataFrame:
    """The counts of the strong kinds, SHA-256 of the strong spans, and all spans as text."""
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in (*BASE, *WEAK)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
