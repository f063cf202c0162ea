"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Each word is a vector of its own (known words) and of its character n-grams (any word), so that inflected and unseen
words are read by their parts. A word of more than 40 characters (a sentence of an unspaced script, a joined run) is read in
overlapping pieces, each a step with the word's own vector and the piece's n-grams; a shorter one is one step. A window of steps is read in both directions, attention pools the states, and a logistic
unit scores it. Windows overlap and cover the whole text; the text's score is a calibrated function of the highest one.

Training is numpy on the driver, over a bounded sample of labelled rows (SAMPLE of each class, by the order of a hash).
A text's label is known, not which window earned it, so of each text the windows with the most telling words are used,
which are the hardest ones of clean texts. Only the text is an input of a score.

Edge cases: a null or empty text, or one of white space, is one window without words and scores the base rate; equal texts
have equal scores; rows without a label or with a null in one aren't trained on; with one class only, or no labels at
all, every text scores that class's rate (0.5 without rows); extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

#: Labelled texts of each class that are trained on at most, and the longest such text in characters.
SAMPLE, LONGEST = 1500, 200_000
WINDOW, STRIDE = 64, 48
VOCABULARY, NGRAMS, SIZES = 4000, 20_000, (3, 4, 5)
#: Signs of a word with its two marks that one step reads, and how many of them the next step reads again, so that no n-gram is lost.
PIECE, OVERLAP = 42, max(SIZES) - 1
DIM, HIDDEN, ATTENTION, EPOCHS, BATCH = 4, 8, 8, 5, 256
#: Steps remembered by a worker, and windows read at once.
REMEMBERED, CHUNK = 200_000, 2048
STRIP = ".,;:!?\"'()[]{}<>*#$%&|"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def marked(word: str) -> str:
    return f"^{word}$"


def grams(w: str) -> list[str]:
    """N-grams of a marked word, or of a piece of one."""
    return [w[i : i + k] for k in SIZES for i in range(len(w) - k + 1)]


def pieces(w: str) -> list[str]:
    """A marked word in pieces that together have all of its n-grams."""
    return [w[a : a + PIECE] for a in range(0, max(1, len(w) - OVERLAP), PIECE - OVERLAP)]


def windows(n: int) -> list[int]:
    """Where the windows of so many steps start: the last one reaches the end."""
    return [0] if n <= WINDOW else [*range(0, n - WINDOW, STRIDE), n - WINDOW]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Vectors of words, and the network over them."""

    def __init__(self, vocabulary: dict[str, int], ngrams: dict[str, int], word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.vocabulary, self.ngrams, self.word_odds, self.gram_odds = vocabulary, ngrams, word_odds, gram_odds
        d = 3 + 2 * DIM
        init = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {"word": (0.1 * r.standard_normal((len(vocabulary) + 1, DIM))).astype(np.float32), "gram": (0.1 * r.standard_normal((len(ngrams) + 1, DIM))).astype(np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": init(d, 3 * HIDDEN), f"U{side}": init(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": init(2 * HIDDEN, ATTENTION), "v": init(ATTENTION), "o": init(2 * HIDDEN), "k": np.zeros(1, np.float32)}
        self.calibration = (1.0, 0.0, 0.0)
        self.constant: float | None = None

    # vectors of words

    def steps(self, words: list[str]) -> list[str | tuple[int, str]]:
        """The words in order; instead of each long one its pieces, with the word's row."""
        most = PIECE - 2
        if max(map(len, words), default=0) <= most:
            return words
        out: list[str | tuple[int, str]] = []
        for w in words:
            if len(w) > most and len(bare := w.strip(STRIP)) > most:
                row = self.vocabulary.get(bare, 0)
                out += [(row, x) for x in pieces(marked(bare))]
            else:
                out.append(w)
        return out

    def parts(self, step: str | tuple[int, str]) -> tuple[int, list[int]]:
        """Row of the word (0: unknown) and of the known n-grams of what the step reads of it."""
        if isinstance(step, str):
            bare = step.strip(STRIP)
            row, piece = self.vocabulary.get(bare, 0), marked(bare)
        else:
            row, piece = step
        get = self.ngrams.get
        return row, [j for g in grams(piece) if (j := get(g)) is not None]

    def vectors(self, parts: list[tuple[int, list[int]]]) -> np.ndarray:
        ids = np.array([i for i, _ in parts], np.int64)
        sizes = np.array([len(g) for _, g in parts], np.int64)
        flat = np.array([j for _, g in parts for j in g], np.int64)
        own = np.repeat(np.arange(len(parts)), sizes)
        x = np.zeros((len(parts), 3 + 2 * DIM), np.float32)
        x[:, 0] = self.word_odds[ids]
        if len(flat):
            odds = self.gram_odds[flat]
            np.maximum.at(x[:, 1], own, odds)
            x[:, 2] = np.bincount(own, odds, len(parts)) / np.maximum(sizes, 1)
            for k in range(DIM):
                x[:, 3 + DIM + k] = np.bincount(own, self.p["gram"][flat, k], len(parts)) / np.maximum(sizes, 1)
        x[:, 3 : 3 + DIM] = self.p["word"][ids]
        return x

    # the network

    def run(self, inputs: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False):
        """Logits of windows from the projected inputs (time, window, 3 * HIDDEN) of each direction."""
        steps, n = mask.shape
        states, saved = np.zeros((steps, n, 2 * HIDDEN), np.float32), {}
        for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
            u = self.p[f"U{side}"]
            uz, uh = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
            h = np.zeros((n, HIDDEN), np.float32)
            at = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            x, trace = inputs[side], {}
            for t in order:
                g = 1 / (1 + np.exp(-np.clip(x[t][:, : 2 * HIDDEN] + h @ uz, -30, 30)))
                z, r = g[:, :HIDDEN], g[:, HIDDEN:]
                new = np.tanh(x[t][:, 2 * HIDDEN :] + (r * h) @ uh)
                before = h
                h = h + mask[t][:, None] * (z * (new - h))
                states[t, :, at] = h
                if keep:
                    trace[t] = (before, z, r, new)
            saved[side] = trace
        a = np.tanh(states @ self.p["A"])
        e = a @ self.p["v"] + np.where(mask > 0, 0, -1e9).astype(np.float32)
        w = np.exp(e - e.max(0))
        w = w * mask
        w /= np.maximum(w.sum(0), 1e-9)
        pooled = (w[:, :, None] * states).sum(0)
        out = pooled @ self.p["o"] + self.p["k"][0]
        return (out, (states, saved, a, w, pooled)) if keep else out

    def project(self, x: np.ndarray, side: str) -> np.ndarray:
        return x @ self.p[f"W{side}"] + self.p[f"c{side}"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Of the logistic loss, for the parameters of the network and for the inputs (time, window, features)."""
        inputs = {s: self.project(x, s) for s in "fb"}
        out, (states, saved, a, w, pooled) = self.run(inputs, mask, True)
        d_out = (weight * (sigmoid(out) - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ d_out, "k": d_out.sum(keepdims=True)}
        d_pooled = d_out[:, None] * self.p["o"]
        d_states = w[:, :, None] * d_pooled
        d_w = (states * d_pooled).sum(2)
        d_e = w * (d_w - (w * d_w).sum(0))
        g["v"] = np.tensordot(d_e, a, ((0, 1), (0, 1)))
        d_a = d_e[:, :, None] * self.p["v"] * (1 - a * a)
        g["A"] = np.tensordot(states, d_a, ((0, 1), (0, 1)))
        d_states = d_states + d_a @ self.p["A"].T
        d_x = np.zeros_like(x)
        steps = len(mask)
        for side, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
            u = self.p[f"U{side}"]
            uz, uh = u[:, : 2 * HIDDEN], u[:, 2 * HIDDEN :]
            at = slice(0, HIDDEN) if side == "f" else slice(HIDDEN, 2 * HIDDEN)
            d_u, d_in = np.zeros_like(u), np.zeros((steps, x.shape[1], 3 * HIDDEN), np.float32)
            d_h = np.zeros((x.shape[1], HIDDEN), np.float32)
            for t in order:
                before, z, r, new = saved[side][t]
                d_h = d_h + d_states[t, :, at]
                m = mask[t][:, None]
                d_new = m * d_h * z * (1 - new * new)
                d_z = m * d_h * (new - before) * z * (1 - z)
                d_rh = d_new @ uh.T
                d_r = d_rh * before * r * (1 - r)
                d_zr = np.concatenate([d_z, d_r], 1)
                d_u[:, : 2 * HIDDEN] += before.T @ d_zr
                d_u[:, 2 * HIDDEN :] += (r * before).T @ d_new
                d_in[t] = np.concatenate([d_zr, d_new], 1)
                d_h = d_h * (1 - m * z) + d_rh * r + d_zr @ uz.T
            g[f"U{side}"] = d_u
            g[f"W{side}"] = np.tensordot(x, d_in, ((0, 1), (0, 1)))
            g[f"c{side}"] = d_in.sum((0, 1))
            d_x += d_in @ self.p[f"W{side}"].T
        return g, d_x

    # scores of texts

    def reader(self):
        """A function from texts to (highest logit, number of windows), which remembers steps' projected vectors."""
        memory = {"ids": {}, "rows": None}

        def logits(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            ids = memory["ids"]
            if len(ids) > REMEMBERED:
                ids.clear()
                memory["rows"] = None
            split = [self.steps(words_of(x)) for x in texts]
            new = list({w for ws in split for w in ws if w not in ids})
            if memory["rows"] is None:
                memory["rows"] = {s: np.zeros((1, 3 * HIDDEN), np.float32) for s in "fb"}
            if new:
                for a in range(0, len(new), 50_000):
                    x = self.vectors([self.parts(w) for w in new[a : a + 50_000]])
                    first = len(memory["rows"]["f"])
                    memory["rows"] = {s: np.concatenate([memory["rows"][s], self.project(x, s)]) for s in "fb"}
                    ids.update(zip(new[a : a + 50_000], range(first, first + len(x)), strict=True))
            get = ids.__getitem__
            flat = np.fromiter((get(w) for ws in split for w in ws), np.int64, sum(map(len, split)))
            starts, lengths, owner, offset = [], [], [], 0
            for d, ws in enumerate(split):
                for s in windows(len(ws)):
                    starts.append(offset + s)
                    lengths.append(min(WINDOW, len(ws)))
                    owner.append(d)
                offset += len(ws)
            lengths, starts, owner = np.array(lengths), np.array(starts), np.array(owner)
            best = np.full(len(texts), -np.inf, np.float32)
            order = np.argsort(lengths, kind="stable")
            for a in range(0, len(order), CHUNK):
                o = order[a : a + CHUNK]
                steps = max(1, int(lengths[o].max()))
                time = np.arange(steps)[:, None]
                mask = (time < lengths[o]).astype(np.float32)
                at = np.where(mask > 0, flat[np.minimum(starts[o] + time, max(len(flat) - 1, 0))] if len(flat) else 0, 0)
                out = self.run({s: Rows(memory["rows"][s], at) for s in "fb"}, mask)
                np.maximum.at(best, owner[o], out)
            return best, np.bincount(owner, minlength=len(texts))

        return logits

    def probability(self, best: np.ndarray, count: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return sigmoid(a * best.astype(float) + b * np.log(count) + c)


class Rows:
    """Projected inputs of each step, looked up when they are asked for."""

    def __init__(self, rows: np.ndarray, at: np.ndarray) -> None:
        self.rows, self.at = rows, at

    def __getitem__(self, t: int) -> np.ndarray:
        return self.rows[self.at[t]]


def odds(toxic: Counter, clean: Counter, n_toxic: int, n_clean: int, key: str) -> float:
    """Log ratio of the shares of texts with a word or n-gram; what few texts have counts little."""
    eps = max(0.005, 3 / max(1, n_toxic))
    return float(np.log((toxic[key] / n_toxic + eps) / (clean[key] / n_clean + eps)))


def trained(rows: list[tuple[str | None, int]], share: float, seed: int = 0) -> Network:
    """A network from texts and labels; ``share``: of label 1 among all labelled rows."""
    labels = np.array([y for _, y in rows], int)
    if len(set(labels.tolist())) < 2:
        net = Network({}, {}, np.zeros(1, np.float32), np.zeros(1, np.float32))
        net.constant = float(labels[0]) if len(labels) else 0.5
        return net
    split = [[w.strip(STRIP) for w in words_of(x)] for x, _ in rows]
    count = {0: (Counter(), Counter()), 1: (Counter(), Counter())}
    for ws, y in zip(split, labels.tolist(), strict=True):
        own = set(ws)
        count[y][0].update(own)
        count[y][1].update({g for w in own for g in grams(marked(w))})
    sizes = {y: int((labels == y).sum()) for y in (0, 1)}

    def strongest(which: int, most: int) -> dict[str, float]:
        t, c = count[1][which], count[0][which]
        got = {k: odds(t, c, sizes[1], sizes[0], k) for k in {k for k, v in (t + c).items() if v >= 3}}
        return dict(sorted(got.items(), key=lambda kv: (-abs(kv[1]), kv[0]))[:most])

    word_odds, gram_odds = strongest(0, VOCABULARY), strongest(1, NGRAMS)
    net = Network({w: i + 1 for i, w in enumerate(word_odds)}, {g: i + 1 for i, g in enumerate(gram_odds)}, np.array([0.0, *word_odds.values()], np.float32), np.array([0.0, *gram_odds.values()], np.float32), seed)
    # the most telling window of each text, and another one
    r = np.random.default_rng(seed)
    known: dict[str, tuple] = {}
    tell: dict[str, float] = {}
    examples: list[tuple[list[tuple], int]] = []
    for ws, y in zip(map(net.steps, split), labels.tolist(), strict=True):
        for w in set(ws):
            if w not in known:
                known[w] = p = net.parts(w)
                tell[w] = max([net.word_odds[p[0]], *net.gram_odds[p[1]].tolist()])
        value = np.array([tell[w] for w in ws] or [0.0])
        starts = windows(len(ws))
        total = [np.sort(value[s : s + WINDOW])[-3:].sum() for s in starts]
        top = int(np.argmax(total))
        examples.append(([known[w] for w in ws[starts[top] : starts[top] + WINDOW]], y))
        if y == 0 and len(starts) > 1:
            s = starts[int(r.integers(len(starts)))]
            examples.append(([known[w] for w in ws[s : s + WINDOW]], 0))
    y_all = np.array([y for _, y in examples], np.float32)
    weight = np.where(y_all == 1, len(y_all) / (2 * max(1, y_all.sum())), len(y_all) / (2 * max(1, (1 - y_all).sum()))).astype(np.float32)
    m1, m2, step = {k: np.zeros_like(v) for k, v in net.p.items()}, {k: np.zeros_like(v) for k, v in net.p.items()}, 0
    epochs = EPOCHS if len(examples) > 4 * BATCH else EPOCHS * 4
    for _ in range(epochs):
        order = r.permutation(len(examples))
        for a in range(0, len(order), BATCH):
            pick = order[a : a + BATCH]
            batch = [examples[i][0] for i in pick]
            steps = max(1, max(map(len, batch)))
            mask = np.array([[float(t < len(b)) for b in batch] for t in range(steps)], np.float32)
            flat = [p for b in batch for p in b]
            place = np.zeros((steps, len(batch)), np.int64)
            k = 0
            for j, b in enumerate(batch):
                place[: len(b), j] = np.arange(k, k + len(b))
                k += len(b)
            vectors = net.vectors(flat) if flat else np.zeros((1, 3 + 2 * DIM), np.float32)
            g, d_x = net.gradients(vectors[place] * mask[:, :, None], mask, y_all[pick], weight[pick])
            d_v = np.zeros_like(vectors)
            np.add.at(d_v, place[mask > 0], d_x[mask > 0])
            g["word"], g["gram"] = np.zeros_like(net.p["word"]), np.zeros_like(net.p["gram"])
            if flat:
                np.add.at(g["word"], [i for i, _ in flat], d_v[:, 3 : 3 + DIM])
                lens = np.array([len(x) for _, x in flat])
                own = np.repeat(np.arange(len(flat)), lens)
                np.add.at(g["gram"], [j for _, x in flat for j in x], (d_v[:, 3 + DIM :] / np.maximum(lens, 1)[:, None])[own])
            g["word"][0] = 0
            step += 1
            for k_, v in g.items():
                m1[k_] = 0.9 * m1[k_] + 0.1 * v
                m2[k_] = 0.999 * m2[k_] + 0.001 * v * v
                net.p[k_] -= 0.01 * (m1[k_] / (1 - 0.9**step)) / (np.sqrt(m2[k_] / (1 - 0.999**step)) + 1e-8)
    # calibration of whole texts, at the share of labels that the rows have
    read = net.reader()
    got = [read([x for x, _ in rows[a : a + 200]]) for a in range(0, len(rows), 200)]
    best, n = np.concatenate([b for b, _ in got]).astype(float), np.concatenate([c for _, c in got])
    x = np.stack([best, np.log(n), np.ones(len(n))], 1)
    true = share / max(1e-9, labels.mean())
    false = (1 - share) / max(1e-9, 1 - labels.mean())
    w, c = np.where(labels == 1, true, false), np.array([1.0, 0.0, 0.0])
    for _ in range(50):  # Newton steps of a weighted, slightly held back logistic fit
        p = sigmoid(x @ c)
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-2 * len(x) * np.diag([1e-2, 1e-1, 1e-3])
        c = c + np.clip(np.linalg.solve(h, x.T @ (w * (labels - p)) - 1e-2 * len(x) * np.array([1e-2, 1e-1, 1e-3]) * (c - np.array([1.0, 0.0, 0.0]))), -2, 2)
    net.calibration = tuple(float(v) for v in c)
    return net


def _work(net: Network):
    read = net.reader()

    def rows(texts):
        if net.constant is not None:
            return [(net.constant,) for _ in texts]
        return [(float(p),) for p in net.probability(*read(texts))]

    return rows


def fitted(docs: DataFrame, labels: DataFrame, held_out, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network:
    """A network from the labelled rows that aren't held out, SAMPLE of each class at most."""
    rows = labels.select(F.col(key).alias("__id"), F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("__id").isNotNull() & ~held_out(F.col("__id"))).distinct()
    counts = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    # ids first, by the order of a hash: texts of no other rows are moved
    picked = [rows.where(F.col("y") == y).orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE).select("__id", "y") for y in (0, 1)]
    sample = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.length("text") <= LONGEST).join(F.broadcast(picked[0].unionByName(picked[1])), F.col("id") == F.col("__id"))
    got = sorted(((r["id"], r["text"], r["y"]) for r in sample.select("id", "text", "y").collect()), key=lambda x: (str(x[0]), x[1], x[2]))
    return trained([(t, y) for _, t, y in got], counts.get(1, 0) / total if total else 0.5)


def held_out(key):
    """Rows that are never trained on: a fifth, by the id's checksum."""
    return F.crc32(key.cast("string")) % 5 == 0


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted`` of every text."""
    net = fitted(docs, labels, held_out, key, text)
    scored = map_texts(docs, partial(_work, net), "score double", key, text)
    return scored.select(key, F.coalesce(held_out(F.col(key)), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
