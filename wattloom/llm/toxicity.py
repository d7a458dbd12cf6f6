"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy (operator 4).

Input of a word: an embedding of the word (hashed) and the mean embedding of its character 3-, 4- and 5-grams (hashed).
Both tables start from smoothed log odds of the training labels in their first column. A forward and a backward GRU
run over a window of words; attention weights pool their states into one logit. Windows of 32 words begin every 16 words,
so they overlap by half, and cover the whole text; a document's score is that of its highest window, in training too:
all its windows are scored, and gradients go to the highest.

The network is fitted on the driver on a bounded sample of labelled rows: at most ``MAX_TOXIC`` and ``MAX_CLEAN`` documents in
hash order, whole texts, weighted to the classes' true shares. Of rows that share a labelled id the smallest text is
taken. Labels of held-out rows (crc32 of the id as text, modulo 4, is 2) are never read. Scoring is a map over all rows without a shuffle: the input
projections of each distinct word are kept, so a word costs a look-up and its share of the recurrences.

Nulls: null and empty texts, and texts without words, get the share of toxic training labels as score. A null doc_id is
not held out. A label row with null toxic or doc_id is ignored; without both classes every score is that share (0
without labels). Repeated rows each get their score. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, word_list

#: Bounds of the labelled documents that the network is fitted on.
MAX_TOXIC, MAX_CLEAN = 1500, 2000
WINDOW, STRIDE = 32, 16
WORDS, GRAMS = 1 << 15, 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 4, 6, 8, 8
EPOCHS, BATCH, RATE, SEED = 5, 32, 0.01, 4
PREDICT_AT = 0.3
_K = np.uint64(0x9E3779B97F4A7C15)


def word_ids(words: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(w) % WORDS for w in words], np.int64)


def word_grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed character-gram ids of all words in order, number of each word's), with marks for both ends."""
    raw = b"".join(b"\x02" + w + b"\x03" for w in words)
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), length)
    last = np.cumsum(length)[owner]
    ids, own = [], []
    for n in (3, 4, 5):
        m = len(x) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for i in range(n):
            h = (h ^ x[i : m + i]) * _K
            h ^= h >> np.uint64(32)
        ok = np.arange(m) + n <= last[:m]
        ids.append((h[ok] % np.uint64(GRAMS)).astype(np.int64))
        own.append(owner[:m][ok])
    ids, own = np.concatenate(ids), np.concatenate(own)
    order = np.argsort(own, kind="stable")
    return ids[order], np.bincount(own, minlength=len(words))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, seed: int = SEED):
        rng = np.random.default_rng(seed)
        d = WORD_DIM + GRAM_DIM
        init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "word": (rng.standard_normal((WORDS, WORD_DIM)) * 0.05).astype(np.float32),
            "gram": (rng.standard_normal((GRAMS, GRAM_DIM)) * 0.05).astype(np.float32),
            "attend": init(2 * HIDDEN, ATTEND), "query": init(ATTEND), "out": init(2 * HIDDEN), "bias": np.full(1, -2, np.float32),
        }
        for side in ("f", "b"):
            self.p |= {f"x{side}": init(d, 3 * HIDDEN), f"h{side}": init(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.rate = 0.0

    def vectors(self, words: list[bytes]) -> np.ndarray:
        return self.embed(word_ids(words), *word_grams(words))

    def embed(self, ids: np.ndarray, grams: np.ndarray, n: np.ndarray) -> np.ndarray:
        starts = np.r_[0, np.cumsum(n)[:-1]]
        mean = np.add.reduceat(self.p["gram"][grams], starts, axis=0) / n[:, None]
        return np.hstack([self.p["word"][ids], mean]).astype(np.float32)

    def inputs(self, x: np.ndarray) -> np.ndarray:
        """Projections of word vectors for both directions, with a row for padding at the end: words + 1, 2, 3 HIDDEN."""
        x = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        return np.stack([x @ self.p[f"x{s}"] + self.p[f"c{s}"] for s in "fb"], axis=1)

    def forward(self, rows: np.ndarray, projected: np.ndarray, pad: int, keep: bool = False):
        """Logits of windows; rows: WINDOW x windows indices into projected. keep: also what backward() needs."""
        steps, n = rows.shape
        states = np.zeros((steps, n, 2 * HIDDEN), np.float32)
        saved = []
        H = HIDDEN
        for k, side in enumerate("fb"):
            u, h = self.p[f"h{side}"], np.zeros((n, H), np.float32)
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                a, hu = projected[rows[t], k], h @ u
                zr = _sigmoid(a[:, : 2 * H] + hu[:, : 2 * H])
                z, r = zr[:, :H], zr[:, H:]
                c = np.tanh(a[:, 2 * H :] + r * hu[:, 2 * H :])
                new = c + z * (h - c)
                if keep:
                    saved.append((t, h, z, r, c, hu[:, 2 * H :]))
                h = new
                states[t, :, k * H : k * H + H] = h
        m = np.tanh(states @ self.p["attend"])
        e = np.where(rows == pad, np.float32(-1e9), m @ self.p["query"])
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnd->nd", w, states)
        logits = pooled @ self.p["out"] + self.p["bias"]
        return (logits, (states, m, w, pooled, saved)) if keep else logits

    def backward(self, slope: np.ndarray, rows: np.ndarray, projected: np.ndarray, x: np.ndarray, parts: tuple, memory: tuple) -> dict:
        """Gradients for d loss / d logits = slope; dense for all but the two tables, which come as (ids, rows)."""
        states, m, w, pooled, saved = memory
        H, p = HIDDEN, self.p
        g = {"out": pooled.T @ slope, "bias": slope.sum(keepdims=True)}
        dp = slope[:, None] * p["out"]
        dw = np.einsum("nd,tnd->tn", dp, states)
        ds = w[:, :, None] * dp
        de = w * (dw - (w * dw).sum(0))
        g["query"] = np.einsum("tn,tna->a", de, m)
        da = de[:, :, None] * p["query"] * (1 - m * m)
        g["attend"] = np.einsum("tnd,tna->da", states, da)
        ds += da @ p["attend"].T
        back = np.zeros_like(projected)
        for k, side in enumerate("fb"):
            u, gu = p[f"h{side}"], np.zeros_like(p[f"h{side}"])
            dh = np.zeros((rows.shape[1], H), np.float32)
            own = saved[: rows.shape[0]] if k == 0 else saved[rows.shape[0] :]
            for t, h, z, r, c, hun in reversed(own):
                dh = dh + ds[t, :, k * H : k * H + H]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * hun * r * (1 - r)
                dhu = np.hstack([dz, dr, dc * r])
                np.add.at(back[:, k], rows[t], np.hstack([dz, dr, dc]))
                gu += h.T @ dhu
                dh = dh * z + dhu @ u.T
            g[f"h{side}"] = gu
        full = np.vstack([x, np.zeros((1, x.shape[1]), np.float32)])
        dx = np.zeros_like(full)
        for k, side in enumerate("fb"):
            g[f"x{side}"], g[f"c{side}"] = full.T @ back[:, k], back[:, k].sum(0)
            dx += back[:, k] @ p[f"x{side}"].T
        ids, grams, n = parts
        dx = dx[:-1]
        g["word"] = (ids, dx[:, :WORD_DIM])
        g["gram"] = (grams, np.repeat(dx[:, WORD_DIM:] / n[:, None], n, axis=0))
        return g


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, end of the document) of all windows over documents laid end to end; none for empty ones."""
    ends = np.cumsum(counts)
    n = np.where(counts > 0, np.maximum(-(-(counts - WINDOW) // STRIDE) + 1, 1), 0)
    doc = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, (ends - counts)[doc] + nth * STRIDE, ends[doc]


def rows_of(first: np.ndarray, end: np.ndarray, index: np.ndarray, pad: int) -> np.ndarray:
    at = first[None, :] + np.arange(WINDOW)[:, None]
    return np.where(at < end[None, :], index[np.minimum(at, len(index) - 1)], pad)


def train(texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network for documents of both classes."""
    net, rng = Network(seed), np.random.default_rng(seed)
    docs = [word_list(t) for t in texts]
    some = [i for i, d in enumerate(docs) if d]
    net.rate = float((labels * weights).sum() / weights.sum())
    place = {w: j for j, w in enumerate(sorted({w for d in docs for w in d}))}
    ids, (grams, many) = word_ids(list(place)), word_grams(list(place))
    begin = np.r_[0, np.cumsum(many)]
    docs = [np.array([place[w] for w in d], np.int64) for d in docs]

    def parts_of(own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """embed()'s arguments for distinct words of the sample."""
        n = many[own]
        at = np.repeat(begin[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        return ids[own], grams[at], n

    seen = {"word": np.zeros((2, WORDS)), "gram": np.zeros((2, GRAMS))}
    for i in some:
        w, g, _ = parts_of(np.unique(docs[i]))
        seen["word"][int(labels[i]), np.unique(w)] += 1
        seen["gram"][int(labels[i]), np.unique(g)] += 1
    total = np.array([max(1, sum(labels[i] == k for i in some)) for k in (0, 1)])
    for name, n in seen.items():
        odds = np.log((n[1] + 0.3) / (total[1] + 0.6)) - np.log((n[0] + 0.3) / (total[0] + 0.6))
        held = n.sum(0)
        net.p[name][:, 0] = np.clip(odds * held / (held + 4), -1, 4)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(some)
        rate = RATE * (1 - epoch / epochs) + 1e-3
        for a in range(0, len(order), BATCH):
            batch = order[a : a + BATCH]
            doc, start, end = windows_of(np.array([len(docs[i]) for i in batch]))
            own, words = np.unique(np.concatenate([docs[i] for i in batch]), return_inverse=True)
            rows = rows_of(start, end, words, len(own))
            inputs = net.inputs(net.embed(*parts_of(own)))
            logits = np.concatenate([net.forward(rows[:, i : i + 2048], inputs, len(own)) for i in range(0, rows.shape[1], 2048)])
            best = np.array([np.flatnonzero(doc == d)[np.argmax(logits[doc == d])] for d in range(len(batch))])
            used, rows = np.unique(rows[:, best], return_inverse=True)
            rows, used = rows.reshape(WINDOW, -1), used[used < len(own)]
            parts = parts_of(own[used])
            x = net.embed(*parts)
            projected, pad = net.inputs(x), len(used)
            logits, memory = net.forward(rows, projected, pad, keep=True)
            slope = ((_sigmoid(logits) - labels[batch]) * weights[batch] / weights[batch].mean() / len(batch)).astype(np.float32)
            grads = net.backward(slope, rows, projected, x, parts, memory)
            step += 1
            for k, g in grads.items():
                if isinstance(g, tuple):
                    at, inverse = np.unique(g[0], return_inverse=True)
                    rowsum = np.zeros((len(at), g[1].shape[1]), np.float32)
                    np.add.at(rowsum, inverse, g[1])
                    first[k][at] = 0.9 * first[k][at] + 0.1 * rowsum
                    second[k][at] = 0.99 * second[k][at] + 0.01 * rowsum**2
                    move = first[k][at] / (np.sqrt(second[k][at]) + 1e-6)
                    net.p[k][at] -= 0.3 * rate * move
                else:
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


class Scorer:
    """Scores whole texts; keeps the projections of the words it has met, within a bound."""

    def __init__(self, net: Network, keep: int = 150_000):
        self.net, self.keep, self.size = net, keep, 0
        self.place: dict[bytes, int] = {}
        self.blank = net.inputs(np.zeros((0, WORD_DIM + GRAM_DIM), np.float32))[0]
        self.table = np.zeros((1, *self.blank.shape), np.float32)

    def _index(self, words: list[bytes]) -> np.ndarray:
        """Rows of self.table for words; those beyond the bound get rows that only this call's windows use."""
        out = list(map(self.place.get, words))
        new: dict[bytes, int] = {}
        room = self.size
        for i, at in enumerate(out):
            if at is None:
                at = new.get(words[i])
                if at is None:
                    new[words[i]] = at = room + len(new)
                out[i] = at
        if new:
            made = self.net.inputs(self.net.vectors(list(new)))[:-1]
            if room + len(new) + 1 > len(self.table):
                grown = np.zeros((room + 2 * len(new) + 1024, *made.shape[1:]), np.float32)
                grown[:room] = self.table[:room]
                self.table = grown
            self.table[room : room + len(new)] = made
            if room < self.keep:
                self.place.update(new)
                self.size += len(new)
        self.table[-1] = self.blank
        return np.array(out, np.int64)

    def scores(self, texts: list[str | None]) -> list[float]:
        out = [self.net.rate] * len(texts)
        group: list[tuple[int, list[bytes]]] = []
        held = 0
        for i, text in enumerate(texts):
            words = word_list(text)
            if words:
                group.append((i, words))
                held += len(words)
            if group and (held > 60_000 or i == len(texts) - 1):
                self._group(group, out)
                group, held = [], 0
        if group:
            self._group(group, out)
        return out

    def _group(self, group: list[tuple[int, list[bytes]]], out: list[float]) -> None:
        index = self._index([w for _, words in group for w in words])
        pad = len(self.table) - 1
        doc, start, end = windows_of(np.array([len(words) for _, words in group]))
        best = np.full(len(group), -np.inf)
        for a in range(0, len(doc), 2048):
            part = slice(a, a + 2048)
            rows = rows_of(start[part], end[part], index, pad)
            np.maximum.at(best, doc[part], self.net.forward(rows, self.table, pad))
        for (i, _), v in zip(group, best):
            out[i] = float(_sigmoid(v))


def held_out(doc_id: F.Column) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Network:
    """The network, from at most max_toxic and max_clean labelled documents that are not held out."""
    known = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionByName(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    rows = sorted(rows, key=lambda r: r["doc_id"])
    y = np.array([r["toxic"] for r in rows], np.float32)
    if len(set(y.tolist())) < 2:
        net = Network()
        net.rate = float(y.mean()) if len(y) else 0.0
        net.p["out"][:] = 0
        net.p["bias"][:] = np.log(max(net.rate, 1e-3) / max(1 - net.rate, 1e-3))
        return net
    share = {k: counts[k] / max(1, int((y == k).sum())) for k in (0, 1)}
    return train([r["text"] or "" for r in rows], y, np.array([share[int(v)] for v in y], np.float32))


def score_toxicity(
    docs: DataFrame, labels: DataFrame, predict_at: float = PREDICT_AT, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN
) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_toxic, max_clean))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for b in slices(batches, 2048):
            scores = scorer.scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= predict_at).cast("int").alias("predicted"))
