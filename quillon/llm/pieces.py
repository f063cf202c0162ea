"""SentencePiece encoding and decoding, for models of the merge (BPE) type.

Encoding is exact without running the merges over a text: the longest pieces at each position come from an Aho-Corasick
automaton, a piece is taken if it is compatible with the one before it (the two texts, merged again from their
characters, give the same two pieces), and where no piece of a position fits, the position is marked in a bitfield as
failed and the search goes one piece back. Work is linear in the text but for marked positions, each visited once.

A text is cut where no piece of the vocabulary can reach across: before a space mark that follows something else, and
around characters that stand in no longer piece. Cuts are therefore exact too, and equal stretches are encoded once.

Stretches with pieces of equal score (runs of spaces in common models), where the merge order depends on the position
and not on the pair alone, are merged directly.

Edge cases: a null or empty text has no ids and decodes to the empty text; characters outside the vocabulary become
byte pieces; repeated rows each get a row; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from functools import lru_cache, partial

from pyspark.sql import DataFrame

from .common import map_texts, remembers, works

MARK = "▁"
#: Stretches remembered by a worker in each of two generations, the longest that are, and the pairs of pieces.
REMEMBERED, LONGEST, PAIRS = 200_000, 40, 1_000_000


class Pieces:
    """A merge-type model with byte fallback and without a normalization table."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(self.size)]
        special = {i for i in range(self.size) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)}
        self.control = {i for i in range(self.size) if model.is_control(i)}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.unknown = model.unk_id()
        self.id = {self.piece[i]: i for i in range(self.size) if i not in special}
        self.score = [model.get_score(i) for i in range(self.size)]
        of_byte = {i: bytes([b]) for b, i in self.byte.items()}
        self.raw = [of_byte[i] if i in of_byte else b"" if i in self.control else self.piece[i].replace(MARK, " ").encode() for i in range(self.size)]
        self.auto = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        count: dict[float, int] = {}
        for p, i in self.id.items():
            if len(p) > 1:
                count[self.score[i]] = count.get(self.score[i], 0) + 1
        tied = {p for p, i in self.id.items() if len(p) > 1 and count[self.score[i]] > 1}
        #: Pieces whose score another one has, without those that hold another such piece.
        self.tied = [p for p in tied if not any(p[a:b] in tied for a in range(len(p)) for b in range(a + 2, len(p) + 1) if b - a < len(p))]
        inner = {c for p in self.id if len(p) > 1 for c in p}
        self.lonely = "".join(c for c in "\n\t\r" if c not in inner)
        across = any(p[k] != MARK and p[k + 1] == MARK for p in self.id for k in range(len(p) - 1))
        lone = re.escape(self.lonely)
        self.stretch = re.compile(f"[^{lone}]+|[{lone}]" if across and lone else "(?s:.+)" if across else f"{MARK}+[^{MARK}{lone}]*|[{lone}]|[^{MARK}{lone}]+" if lone else f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.chars = [len(p) for p in self.piece]
        #: The next shorter piece that starts a piece; -1: none.
        self.shorter = [next((j for k in range(len(p) - 1, 0, -1) if (j := self.id.get(p[:k])) is not None), -1) for p in self.piece]
        self.fits: dict[tuple[int, int], bool] = {}
        #: Stretches met lately, in two generations: a full one becomes the older one.
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def merge(self, text: str) -> list[int]:
        """The merges themselves: best score first, then leftmost."""
        parts: list[str] = list(text)
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := self.id.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (-self.score[i], a, b, self.piece[i]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, a, b, both = heapq.heappop(heap)
            if not parts[a] or not parts[b] or right[a] != b or parts[a] + parts[b] != both:
                continue
            parts[a], parts[b] = both, ""
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            offer(left[a], a)
            offer(a, right[a])
        return [i for p in parts if p for i in self.of(p)]

    def of(self, symbol: str) -> list[int]:
        return [i] if (i := self.id.get(symbol)) is not None else [self.byte[b] for b in symbol.encode("utf-8", "surrogatepass")]

    def compatible(self, a: int, b: int) -> bool:
        """Whether both texts, merged again together, stay these two pieces."""
        if (ok := self.fits.get((a, b))) is None:
            ok = self.merge(self.piece[a] + self.piece[b]) == [a, b]
            if len(self.fits) < PAIRS:
                self.fits[a, b] = ok
        return ok

    def longest(self, text: str, pos: int) -> int:
        """The longest piece that starts at ``pos``; -2: none does."""
        for end, (size, i) in self.auto.iter_long(text, pos):
            return i if end + 1 - size == pos else -2
        return -2

    def backtrack(self, text: str) -> list[int]:
        """Ids of a stretch, by the longest compatible pieces."""
        if any(x in text for x in self.tied):
            return self.merge(text)
        n = len(text)
        longest = {e + 1 - f[0]: f[1] for e, f in self.auto.iter_long(text)}  # on the greedy path
        out: list[tuple[int, int]] = []  # position and id, or -1
        failed = bytearray((n >> 3) + 1)
        fits, shorter, size = self.fits, self.shorter, self.chars
        pos, last = 0, -1
        i = self.longest(text, 0) if 0 not in longest else longest[0]
        while True:
            while i >= 0:
                end = pos + size[i]
                if not failed[end >> 3] >> (end & 7) & 1 and (last < 0 or (ok if (ok := fits.get((last, i))) is not None else self.compatible(last, i))):
                    out.append((pos, i))
                    pos, last = end, i
                    break
                i = shorter[i]
            else:
                if i == -2:  # a character outside the vocabulary merges with nothing
                    out.append((pos, -1))
                    pos, last = pos + 1, -1
                else:
                    failed[pos >> 3] |= 1 << (pos & 7)
                    pos, i = out.pop()
                    i = shorter[i]
                    last = out[-1][1] if out else -1
                    continue
            if pos == n:
                break
            if (i := longest.get(pos, -3)) == -3:
                i = self.longest(text, pos)
        ids: list[int] = []
        for p, i in out:
            if i >= 0:
                ids.append(i)
            else:
                ids += self.of(text[p])
        return ids

    def stretches(self, text: str) -> list[str]:
        return self.stretch.findall(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, text: str | None) -> list[int]:
        return [i for s in self.stretches(text or "") for i in self.backtrack(s)]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space mark that encoding put first is taken off."""
        raw = b"".join([self.raw[i] for i in ids])
        first = next((i for i in ids if i not in self.control), None)
        text = raw.decode("utf-8", "replace")
        return text[1:] if first is not None and self.piece[first].startswith(MARK) else text

    def pieces_of(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        """Ids, their decimal form and their bytes of each stretch of a text; equal stretches are encoded and decoded once."""
        known, got = self.known, []
        for s in self.stretches(text):
            if (x := known.get(s)) is None:
                if (x := self.older.get(s)) is None:
                    ids = self.backtrack(s)
                    x = (tuple(ids), ",".join(map(str, ids)), b"".join([self.raw[i] for i in ids]))
                if len(s) <= LONGEST:
                    if len(known) >= REMEMBERED:
                        self.older, self.known = known, (known := {})
                    known[s] = x
            got.append(x)
        return got

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """How many ids, and SHA-256 of the ids and of the decoded text."""
        if not text:
            none = hashlib.sha256(b"").hexdigest()
            return 0, none, none
        ids, decimal, raw = zip(*self.pieces_of(text), strict=True)
        back = b"".join(raw)
        back = back[1:] if back[:1] == b" " else back
        return sum(map(len, ids)), hashlib.sha256(",".join(decimal).encode()).hexdigest(), hashlib.sha256(back).hexdigest()

    def ids_and_check(self, text: str | None) -> tuple[list[int], bool]:
        """Ids, and whether they decode to the text; a space mark in it decodes to a space."""
        if not text:
            return [], True
        got = self.pieces_of(text)
        back = b"".join([x[2] for x in got])
        return [i for x in got for i in x[0]], back == b" " + text.replace(MARK, " ").encode()


@lru_cache(maxsize=1)
def made(path: str) -> Pieces:
    return Pieces(path)


remembers("pieces", made.cache_clear)


def loaded(path: str) -> Pieces:
    """The model of a worker process, with what it remembers."""
    works("pieces")
    return made(path)


def _digests(path: str):
    p = loaded(path)
    return lambda texts: [p.digest(x) for x in texts]


def _ids(path: str):
    p = loaded(path)
    return lambda texts: [(p.encode(x),) for x in texts]


def _checked(path: str):
    p = loaded(path)
    return lambda texts: [(len(r[0]), *r) for r in map(p.ids_and_check, texts)]


def _texts(path: str, ids_lists):
    p = loaded(path)
    for batch in ids_lists:
        yield batch, [p.decode(x or []) for x in batch.column(1).to_pylist()]


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids`` of every text."""
    return map_texts(docs, partial(_ids, path), "ids array<int>", key, text)


def encoded_checked(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns with ``n_tokens``, ``ids`` and ``decodes_back`` of every text."""
    return map_texts(docs, partial(_checked, path), "n_tokens long, ids array<int>, decodes_back boolean", keep, text)


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """``key, text`` from ``key, ids``."""
    import pyarrow as pa

    kind = encoded.schema[key].dataType.simpleString()

    def run(batches):
        for batch, texts in _texts(path, batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every text, encoded and decoded in one pass."""
    return map_texts(docs, partial(_digests, path), "n_tokens long, ids_sha256 string, decoded_sha256 string", key, text)
