"""Token counts: batch encoding in Arrow functions that return lengths only.

A text is cut at safe boundaries, into pieces that the tokenizer's own first split never joins: an optional space with
the non-spaces after it, or white space by itself. What a piece counts doesn't depend on its neighbours, so a long text
never reaches the tokenizer as a whole, equal pieces are encoded once, and the sum is exact. The pieces not yet known
are encoded in batches balanced by bytes.

Edge cases: a null or empty text has 0 tokens; white space only is counted as the library counts it; repeated rows each
get a row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, remembers, works

#: Unicode White_Space, which the tokenizer's pattern takes as \\s.
SPACE = "\t-\r \x85\xa0  -     　"
#: As the byte-level pattern treats white space: one space goes with what follows, a run leaves its last one.
PIECE = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SPACES = re.compile(f"[{SPACE}]")
LINE_ENDS = re.compile(f"(?! )[{SPACE}]")
#: Pieces remembered by a task, and the longest that are.
REMEMBERED, LONGEST = 400_000, 48
#: Bytes of pieces encoded at once.
BATCH_BYTES = 1_000_000


def balanced(pieces: list[str], most: int = BATCH_BYTES) -> list[list[str]]:
    """The pieces in batches of about equal bytes, each ``most`` or one piece."""
    sizes = [len(x.encode()) for x in pieces]
    n = max(1, -(-sum(sizes) // most))
    share, out, total = sum(sizes) / n, [[]], 0
    for x, size in zip(pieces, sizes, strict=True):
        if out[-1] and total + size > share * len(out):
            out.append([])
        out[-1].append(x)
        total += size
    return out if pieces else []


class Counter:
    """Token counts of texts by a tokenizer file of the ``tokenizers`` library with a byte-level first split."""

    def __init__(self, path: str) -> None:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        first = spec["pre_tokenizer"] or {}
        self.cuttable = spec["normalizer"] is None and first.get("type") == "ByteLevel" and first["use_regex"] and not first["add_prefix_space"]
        added = sorted((x["content"] for x in spec["added_tokens"]), key=len, reverse=True)
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"]):
            self.cuttable = False
        #: Added tokens are found before the first split.
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.words = added
        line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.cuttable &= len(line_end) == 1
        self.line_end = line_end[0]
        self.known: dict[str, int] = {}

    def lengths(self, pieces: list[str]) -> list[int]:
        """Of texts as they are."""
        return [len(x) for batch in balanced(pieces) for x in self.tokenizer.encode_batch(batch, add_special_tokens=False)]

    def piece_lengths(self, pieces: list[str]) -> list[int]:
        """Of pieces: those without inner white space are encoded in one text, with line ends between them.

        A line end is a piece by itself there, and its id stands nowhere else in such a text.
        """
        plain = [x != " " and not SPACES.search(x, 1) and not LINE_ENDS.match(x) and not (self.added and self.added.search(x)) for x in pieces]
        out = dict.fromkeys(range(len(pieces)), 0)
        odd = [i for i, ok in enumerate(plain) if not ok]
        out.update(zip(odd, self.lengths([pieces[i] for i in odd]), strict=True))
        even = [i for i, ok in enumerate(plain) if ok]
        at = 0
        for batch in balanced([pieces[i] for i in even], BATCH_BYTES // 16):
            ids = np.array(self.tokenizer.encode("\n".join(batch), add_special_tokens=False).ids)
            ends = np.flatnonzero(ids == self.line_end)
            counts = np.diff(np.concatenate([[-1], ends, [len(ids)]])) - 1
            assert len(counts) == len(batch)
            out.update(zip(even[at : at + len(batch)], counts.tolist(), strict=True))
            at += len(batch)
        return [out[i] for i in range(len(pieces))]

    def __call__(self, texts: list[str | None]) -> list[int]:
        if not self.cuttable:
            return self.lengths([x or "" for x in texts])
        cut = [self.pieces(x) if x else [] for x in texts]
        known = self.known
        new = list({p for ps in cut for p in ps if p not in known})
        found = dict(zip(new, self.piece_lengths(new), strict=True)) if new else {}
        if len(known) < REMEMBERED:
            known.update((k, v) for k, v in found.items() if len(k) <= LONGEST)
            missing = {k: v for k, v in found.items() if k not in known}
        else:
            missing = found
        if not missing:
            return [sum(map(known.__getitem__, ps)) for ps in cut]
        return [sum([known[p] if p in known else missing[p] for p in ps]) for ps in cut]

    def pieces(self, text: str) -> list[str]:
        if self.added and any(w in text for w in self.words):
            return [p for part in self.added.split(text) for p in ([part] if part in self.words else PIECE.findall(part))]
        return PIECE.findall(text)


@lru_cache(maxsize=1)
def made(path: str) -> Counter:
    return Counter(path)


remembers("counts", made.cache_clear)


def loaded(path: str) -> Counter:
    """The counter of a worker process, with what it remembers."""
    works("counts")
    return made(path)


def _work(path: str):
    counter = loaded(path)

    def rows(texts):
        return [(len(x.encode()) if x else 0, n) for x, n in zip(texts, counter(texts), strict=True)]

    return rows


def token_counts(docs: DataFrame, path: str, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` of every text; ``path``: the tokenizer's file, on every machine."""
    from pyspark.sql import functions as F

    out = map_texts(docs, partial(_work, path), "n_bytes long, n_tokens long", key, text)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["Counter", "balanced", "token_counts"]
