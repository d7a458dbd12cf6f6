"""Cross-entropy difference of two matched bigram models (operator 1).

The target model counts the documents of a target set (by default those labelled quality 1), the background model all
documents. Both share one vocabulary, all words of all documents, and the same smoothing: a bigram's probability is its
count shrunk to the unigram's, which is shrunk to uniform. Words and bigrams are told apart by 64-bit hashes. Documents are dealt by a hash into chunks of about ``OWN_CHUNK`` tokens.

A corpus that is scored by its own models (`score_own`): each chunk sends its distinct keys with their counts to ranges of
about ``RANGE`` keys, where the counts of all chunks are summed by key. Each chunk gets the sums of its own keys back in
their order, without the keys; the texts meet them by chunk and are counted again, which gives the order. Nothing is
broadcast, and no key is looked up.

Models of another corpus, or with limits given (`fit`, `score`): counts are summed within tasks and then by grouped
aggregation into a table in the shared folder. The most frequent words and bigrams (about ``VOCABULARY`` and ``BUCKETS``, at
most) are broadcast with their counts; all others are looked up by a shuffle join; what is found returns to its chunk, and so
do the texts. What occurs once is counted but not stored: without the document's own count it is zero. A filter of ``BITS``
bits, broadcast, spares most look-ups that would find nothing; once it is full it spares fewer. These numbers decide what is
moved, not any result.

Each token's loss is taken under both models without the document's own counts (leave one out), and the score is the
mean of loss(target) - loss(background) in nats: the lower, the closer to the target.

Nulls: null and empty texts have no tokens, null losses and score 0. A null doc_id can't be in the target. Repeated rows
are counted and scored once each. Empty tables or an empty target give the smoothed models of no counts. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import release, sized, slices, stored, trim, word_list

VOCABULARY, BUCKETS = 1 << 16, 1 << 20
#: Pseudo-counts of the lower-order distribution.
SHRINK, UNIFORM = 4.0, 0.5
#: Key that counts the starts of documents; keys of words are even, those of bigrams odd.
START = np.uint64(0)
#: Size of the filter, a power of two.
BITS = 1 << 28
#: Keys that a task holds at once, tokens of a chunk, and found keys that are packed together.
HELD, CHUNK, PACKED = 2_000_000, 1_000_000, 1_000_000
#: Tokens of a chunk and keys of a range where a corpus is scored by its own models, and bytes of text that a token takes at least.
OWN_CHUNK, RANGE, TOKEN_BYTES = 500_000, 1_000_000, 6
SCORES = "doc_id long, n_tokens long, h_target double, h_background double, score double, in_target boolean"
#: Finer than powers of two: classes of counts from which the broadcast ones are chosen.
CLASSES = 8


class Hashes(dict):
    """word -> 64-bit hash, within a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) << 1 & 0xFFFFFFFFFFFFFFFF or 2
        return h


def mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs."""
    h = (x ^ x >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + y
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(29)


@dataclass
class Tokens:
    """Tokens of some texts, end to end."""

    counts: np.ndarray  # of each text
    text: np.ndarray  # of each token
    word: np.ndarray
    before: np.ndarray  # the previous word, or START
    pair: np.ndarray


def tokens_of(texts: list[str | None], hashes: Hashes) -> Tokens:
    lists = [word_list(t) for t in texts]
    counts = np.array([len(ws) for ws in lists], np.int64)
    word = np.fromiter((hashes[w] for ws in lists for w in ws), np.uint64, int(counts.sum()))
    before = np.r_[START, word[:-1]] if len(word) else word
    before[(np.cumsum(counts) - counts)[counts > 0]] = START
    return Tokens(counts, np.repeat(np.arange(len(lists)), counts), word, before, mixed(before, word) | np.uint64(1))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


@dataclass
class Table:
    """Sorted keys with their counts in both models: background, target."""

    keys: np.ndarray
    counts: np.ndarray  # 2 x keys

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether it is here, 2 x keys counts, 0 for others)."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), np.zeros((2, len(keys)))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        here = self.keys[at] == keys
        return here, np.where(here, self.counts[:, at], 0)


def table_of(keys: np.ndarray, b: np.ndarray, t: np.ndarray) -> Table:
    keys, at = np.unique(keys, return_index=True)
    return Table(keys, np.stack([b[at], t[at]]).astype(np.float64).reshape(2, -1))


@dataclass
class Models:
    """Counts of both models: `hot` those held by every task, `cold` all others above one as (key, b, t)."""

    hot: Table
    cold: DataFrame
    left: tuple[bool, bool]  # whether cold has words, bigrams
    seen: np.ndarray  # filter of cold's keys: 64 bits a block
    size: int  # words and one unknown
    totals: tuple[float, float]
    starts: tuple[float, float]


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id, text, target): target is 1 for rows whose doc_id is in the target set."""
    ids = sized(target.select(F.col("doc_id").alias("_id")).where("_id IS NOT NULL").distinct())
    out = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("_id"), "left")
    return out.select("doc_id", "text", F.col("_id").isNotNull().cast("int").alias("target"))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, held, n = Hashes(), ([], []), 0

    def out() -> Iterator[pa.RecordBatch]:
        for kind, parts in enumerate(held):
            if parts:
                keys, many = np.unique(np.concatenate(parts), return_counts=True)
                parts.clear()
                for i in range(0, len(keys), 100_000):
                    own = many[i : i + 100_000].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([_signed(keys[i : i + 100_000]), pa.array(own), pa.array(own * kind)], ["key", "b", "t"])

    for b in slices(batches):
        flags = np.array(b.column("target").to_pylist(), np.int64)
        own = tokens_of(b.column("text").to_pylist(), hashes)
        for kind in (0, 1):
            at = flags[own.text] == kind
            starts = np.full(int(((own.counts > 0) & (flags == kind)).sum()), START)
            held[kind].append(np.concatenate([own.word[at], own.pair[at], starts]))
            n += len(held[kind][-1])
        if n > HELD:
            yield from out()
            n = 0
    yield from out()


def fit(docs: DataFrame, target: DataFrame, vocabulary: int = VOCABULARY, buckets: int = BUCKETS) -> Models:
    """The matched models over all of docs(doc_id, text); vocabulary and buckets: words and bigrams that are broadcast, at most."""
    counts = flagged(docs, target).select("text", "target").mapInArrow(_counted, "key long, b long, t long")
    counts = counts.groupBy("key").agg(F.sum("b").alias("b"), F.sum("t").alias("t"))
    kind, once = F.col("key").bitwiseAND(F.lit(1)), Observation()
    single = (F.col("b") == 1) & (kind == 0) & (F.col("key") != 0)
    counts = counts.observe(once, F.count_if(single).alias("n"), F.coalesce(F.sum(F.when(single, F.col("t"))), F.lit(0)).alias("t"))
    counts = stored(counts.where((F.col("b") > 1) | (F.col("key") == 0)), "lm-counts")
    alone = once.get
    del once
    release(docs.sparkSession)
    level = F.floor(F.log2("b") * CLASSES).cast("int")
    sums = counts.where(F.col("key") != 0).groupBy(kind.alias("kind"), level.alias("level"))
    sums = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"), F.sum("t").alias("t")).collect()
    least, left = [], []
    for k, room in enumerate((vocabulary, buckets)):
        levels = sorted(((r["level"], r["n"]) for r in sums if r["kind"] == k), reverse=True)
        held = np.cumsum([n for _, n in levels])
        fit_in = int(np.searchsorted(held, room, "right"))
        least.append(levels[fit_in - 1][0] if fit_in else 1 << 20)
        left.append(fit_in < len(levels))
    hot = (F.col("key") == 0) | (level >= F.when(kind == 0, least[0]).otherwise(least[1]))
    rows = counts.where(hot).toArrow()
    table = table_of(*(rows.column(c).to_numpy() if c != "key" else rows.column(c).to_numpy().view(np.uint64) for c in ("key", "b", "t")))
    starts = table.find(np.array([START]))[1][:, 0]
    words = [r for r in sums if r["kind"] == 0]
    totals = (float(sum(r["b"] for r in words) + alone["n"]), float(sum(r["t"] for r in words) + alone["t"]))
    cold = counts.where(~hot)
    seen = np.zeros(BITS >> 6 if any(left) else 1, np.uint64)
    if any(left):
        block, mask = F.expr(f"shiftrightunsigned(key, 1) & {len(seen) - 1}L"), F.expr("shiftleft(1L, cast(shiftrightunsigned(key, 40) & 63L as int))")
        blocks = cold.select(block.alias("block"), mask.alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
        seen[blocks.column("block").to_numpy()] = blocks.column("mask").to_numpy().view(np.uint64)
    return Models(table, cold, tuple(left), seen, sum(r["n"] for r in words) + alone["n"] + 1, totals, tuple(starts.tolist()))


def may_hold(seen: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """False only for keys that are not in the filter."""
    bits = seen[(keys >> np.uint64(1)) & np.uint64(len(seen) - 1)]
    return (bits >> (keys >> np.uint64(40) & np.uint64(63)) & np.uint64(1)).astype(bool)


def _own(text: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """How often a token's key occurs in its text."""
    _, at, n = np.unique(mixed(text.astype(np.uint64), keys), return_inverse=True, return_counts=True)
    return n[at]


def losses(own: Tokens, flags: np.ndarray, counts: tuple, size: int, totals: tuple) -> np.ndarray:
    """2 x texts mean negative log probabilities; counts: 2 x tokens of the word, the previous one and the pair."""
    word, context, pair = counts
    mine_word, mine_before, mine_pair = (_own(own.text, k) for k in (own.word, own.before, own.pair))
    out = np.zeros((2, len(own.counts)))
    for m, minus in enumerate((np.ones(len(flags)), flags)):
        each = minus[own.text]
        total = np.maximum(totals[m] - minus * own.counts, 0)[own.text]
        p = (np.maximum(word[m] - each * mine_word, 0) + UNIFORM) / (total + UNIFORM * size)
        c = np.maximum(pair[m] - each * mine_pair, 0)
        n = np.maximum(np.maximum(context[m] - each * mine_before, 0), c)
        loss = -np.log((c + SHRINK * p) / (n + SHRINK))
        out[m] = np.bincount(own.text, weights=loss, minlength=len(own.counts)) / np.maximum(own.counts, 1)
    return out


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (chunk, key, b, t): (chunk, keys, counts), many keys a row; counts by place value, as most are small."""
    held: list[list[np.ndarray]] = []

    def out() -> pa.RecordBatch:
        chunk, key, b, t = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((key, chunk))
        chunk = chunk[order]
        starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
        ends = np.r_[starts[1:], len(chunk)]
        counts = np.stack([b[order], t[order]])
        places = [counts[:, a:e].view(np.uint8).reshape(2, e - a, 8).transpose(0, 2, 1).tobytes() for a, e in zip(starts, ends)]
        keys = [key[order[a:e]].tobytes() for a, e in zip(starts, ends)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[starts], pa.int32()), pa.array(keys, pa.binary()), pa.array(places, pa.binary())], ["chunk", "keys", "counts"])

    for batch in batches:
        if batch.num_rows:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in ("chunk", "key", "b", "t")])
        if sum(len(x[0]) for x in held) > PACKED:
            yield out()
    if held:
        yield out()


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and both counts of a row of packed()."""
    key = np.frombuffer(keys, np.uint64)
    both = np.ascontiguousarray(np.frombuffer(counts, np.uint8).reshape(2, 8, len(key)).transpose(0, 2, 1)).view(np.int64)
    return key, both[0, :, 0], both[1, :, 0]


def score(docs: DataFrame, target: DataFrame, models: Models | None = None, **options) -> DataFrame:
    """doc_id, n_tokens, h_target, h_background, score, in_target: one row for each row of docs."""
    if models is None and not options:
        return score_own(docs, target)
    models = models or fit(docs, target, **options)
    release(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models.hot)
    filtered = docs.sparkSession.sparkContext.broadcast(models.seen)
    left, size, totals = models.left, models.size, models.totals

    chunks = max(1, -(-int(totals[0]) // CHUNK))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, chunk) of what isn't broadcast."""
        hashes = Hashes()
        for b in slices(batches):
            own = tokens_of(b.column("text").to_pylist(), hashes)
            chunk = b.column("chunk").to_numpy(zero_copy_only=False)
            for keys, some in zip((own.word, own.pair), left):
                if some and len(keys):
                    at = np.flatnonzero(may_hold(filtered.value, keys))
                    _, first = np.unique(mixed(chunk[own.text[at]].astype(np.uint64), keys[at]), return_index=True)
                    at = at[first]
                    at = at[~shared.value.find(keys[at])[0]]
                    yield pa.RecordBatch.from_arrays([_signed(keys[at]), pa.array(chunk[own.text[at]])], ["key", "chunk"])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by chunk, what was found (keys is not null) before the documents (b: their flag)."""
        hashes = Hashes()
        last, found, mine = None, [], None
        for batch in slices(batches, 2048):
            chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
            cuts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)].tolist()
            for a, e in zip(cuts[:-1], cuts[1:]):
                if e > a:
                    own = batch.slice(a, e - a)
                    if chunk[a] != last:
                        last, found, mine = chunk[a], [], None
                    n = own.num_rows - own.column("keys").null_count
                    found += [unpacked(k.as_py(), c.as_py()) for k, c in zip(own.column("keys").slice(0, n), own.column("counts").slice(0, n))]
                    for b in slices(iter([own.slice(n)]), 256):
                        if mine is None:
                            none = (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
                            found, mine = [], table_of(*map(np.concatenate, zip(none, *found)))
                        yield one(b, mine, hashes)

    def one(b: pa.RecordBatch, mine: Table, hashes: Hashes) -> pa.RecordBatch:
        own = tokens_of(b.column("text").to_pylist(), hashes)
        flags = b.column("b").to_numpy(zero_copy_only=False).astype(np.int64)

        def counts(keys: np.ndarray) -> np.ndarray:
            here, out = shared.value.find(keys)
            return np.where(here, out, mine.find(keys)[1])

        background, target_loss = losses(own, flags, (counts(own.word), counts(own.before), counts(own.pair)), size, totals)
        empty = own.counts == 0
        return pa.RecordBatch.from_arrays(
            [
                b.column("key"), pa.array(own.counts), pa.array(target_loss, mask=empty), pa.array(background, mask=empty),
                pa.array(np.where(empty, 0.0, target_loss - background)), pa.array(flags == 1),
            ],
            ["doc_id", "n_tokens", "h_target", "h_background", "score", "in_target"],
        )

    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    rows = flagged(docs, target)
    texts = rows.select(
        chunk, F.col("doc_id").cast("long").alias("key"), F.col("target").cast("long").alias("b"), F.lit(None).cast("binary").alias("keys"),
        F.lit(None).cast("binary").alias("counts"), "text",
    )
    if any(left):
        found = docs.select(chunk, "text").mapInArrow(asked, "key long, chunk int").join(models.cold, "key").select("chunk", "key", "b", "t")
        found = found.mapInArrow(packed, "chunk int, keys binary, counts binary")
        none = F.lit(None).cast("long")
        texts = texts.unionByName(found.select("chunk", none.alias("key"), none.alias("b"), "keys", "counts", F.lit(None).cast("string").alias("text")))
        texts = texts.repartition("chunk").sortWithinPartitions("chunk", F.col("keys").isNull())
    return texts.mapInArrow(scored, SCORES)


def _planes(x: np.ndarray) -> bytes:
    """Counts by place value, as few bytes each as the largest needs: most are small."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _counts(raw: bytes) -> np.ndarray:
    """What _planes() packed."""
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view("<u8")[:, 0].astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], extra: str | None = None) -> Iterator[tuple[int, pa.Array, np.ndarray, Tokens, list]]:
    """From rows sorted by chunk: (chunk, doc_ids, flags, tokens, rows that hold `extra`), one a chunk."""
    hashes, last, parts, more = Hashes(), None, [], []

    def whole() -> tuple:
        ids, flags, counts, word = zip(*parts)
        counts, word = np.concatenate(counts), np.concatenate(word)
        before = np.r_[START, word[:-1]] if len(word) else word
        before[(np.cumsum(counts) - counts)[counts > 0]] = START
        own = Tokens(counts, np.repeat(np.arange(len(counts)), counts), word, before, mixed(before, word) | np.uint64(1))
        return last, pa.concat_arrays(ids), np.concatenate(flags), own, more

    for b in slices(batches, 256):
        chunk = b.column("chunk").to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(chunk[1:] != chunk[:-1]) + 1, len(chunk)].tolist()
        for a, e in zip(cuts[:-1], cuts[1:]):
            if e == a:
                continue
            if chunk[a] != last:
                if parts:
                    yield whole()
                last, parts, more = int(chunk[a]), [], []
            rows = b.slice(a, e - a)
            if extra:
                held = rows.filter(rows.column(extra).is_valid())
                more += held.column(extra).to_pylist()
                rows = rows.filter(rows.column(extra).is_null())
            if rows.num_rows:
                lists = [word_list(t) for t in rows.column("text").to_pylist()]
                counts = np.array([len(ws) for ws in lists], np.int64)
                word = np.fromiter(map(hashes.__getitem__, chain.from_iterable(lists)), np.uint64, int(counts.sum()))
                parts.append((rows.column("key"), rows.column("b").to_numpy(zero_copy_only=False).astype(np.int64), counts, word))
    if parts:
        yield whole()


def _step(ranges: int) -> int:
    """Width of a range of keys."""
    return -(-(1 << 64) // ranges)


def _sent(ranges: int):
    """From chunks of texts: (range, chunk, keys, b, t), the distinct keys of a chunk with their counts; ranges ascend with the keys.

    Keys are sent as gaps, the first one's from the start of its range: the more keys a row or ranges there are, the fewer bytes."""
    step = _step(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, flags, own, _ in _chunks(batches):
            inside = flags[own.text] == 1
            started = (own.counts > 0).astype(np.int64)
            all_keys = np.concatenate([own.word, own.pair, np.full(int(started.sum()), START)])
            keys, b = np.unique(all_keys, return_counts=True)
            mine, n = np.unique(np.concatenate([own.word[inside], own.pair[inside], np.full(int(started[flags == 1].sum()), START)]), return_counts=True)
            t = np.zeros(len(keys), np.int64)
            t[np.searchsorted(keys, mine)] = n
            cuts = np.searchsorted(keys, np.array([i * step for i in range(1, ranges)], np.uint64))
            cuts = np.r_[0, cuts, len(keys)]
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            for i in range(0, len(full), 64):
                some = full[i : i + 64]
                gaps = [_planes(np.diff(keys[cuts[r] : cuts[r + 1]], prepend=np.uint64(r * step))) for r in some.tolist()]
                packs = [gaps, *[[_planes(x[cuts[r] : cuts[r + 1]]) for r in some] for x in (b, t)]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array(np.full(len(some), chunk), pa.int32()), *[pa.array(x, pa.binary()) for x in packs]],
                    ["range", "chunk", "keys", "b", "t"],
                )

    return run


SUMS = "chunk int, range int, sums binary, words long, b long, t long"


def _summed(ranges: int):
    """From _sent()'s rows sorted by range: SUMS; sums are those of both counts for the keys of the row it answers.

    words, b and t, in one row of a range: how many words it has and the sums of their counts."""
    step = _step(ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []

        def out() -> Iterator[pa.RecordBatch]:
            keys, b, t = ([_counts(x[i]) for x in held] for i in (1, 2, 3))  # keys: gaps
            ends = np.cumsum([len(k) for k in keys])
            every = np.concatenate([np.cumsum(k.view(np.uint64)) for k in keys]) + np.uint64(last * step)
            order = np.argsort(every)
            ranked = every[order]
            first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
            sizes = np.diff(np.r_[first, len(ranked)])
            word = (ranked[first] & np.uint64(1) == 0) & (ranked[first] != START)
            sums, of_words = [], []
            for x in (b, t):
                total = np.add.reduceat(np.concatenate(x)[order], first)
                of_words.append(int(total[word].sum()))
                back = np.empty(len(order), np.int64)
                back[order] = np.repeat(total, sizes)
                sums.append(np.split(back, ends[:-1]))
            for i in range(0, len(held), 256):
                rows = held[i : i + 256]
                n = len(rows)
                packs = [len(p).to_bytes(8, "little") + p + _planes(y) for x, y in zip(sums[0][i : i + n], sums[1][i : i + n]) for p in (_planes(x),)]
                extra = [[x if not i and not j else 0 for j in range(n)] for x in (int(word.sum()), *of_words)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([last] * n, pa.int32()), pa.array(packs, pa.binary()), *[pa.array(x, pa.int64()) for x in extra]],
                    [x.split()[0] for x in SUMS.split(", ")],
                )
            held.clear()

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("range", "chunk", "keys", "b", "t"))):
                if row[0] != last and held:
                    yield from out()
                last = row[0]
                held.append(row[1:])
        if held:
            yield from out()
        trim()

    return run


def _repeats(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How often a token's `at`, a number under 2^32, occurs in its text."""
    code = text << 32 | at
    order = np.argsort(code)
    ranked = code[order]
    first = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[first, len(code)])
    out = np.empty(len(code), np.int64)
    out[order] = np.repeat(sizes, sizes)
    return out


def _own_losses(own: Tokens, flags: np.ndarray, sums: np.ndarray, size: int, totals: tuple) -> np.ndarray:
    """losses() of a chunk; sums: 2 x its distinct keys, in their order."""
    out = np.zeros((2, len(own.counts)))
    if not len(own.word):
        return out
    n = len(own.word)
    started = own.counts > 0
    ends = np.cumsum(own.counts)[started] - 1
    keys, at = np.unique(np.concatenate([own.word, own.pair, [START]]), return_inverse=True)
    if len(keys) != sums.shape[1]:
        raise ValueError("the texts of a chunk have changed between two reads")
    word, pair, start = at[:n], at[n:-1], at[-1]
    head = np.zeros(n, bool)
    head[np.r_[0, ends[:-1] + 1]] = True
    before = np.where(head, start, np.r_[start, word[:-1]])
    mine_word, mine_pair = _repeats(own.text, word), _repeats(own.text, pair)
    last = np.zeros(len(own.counts), np.int64)
    last[started] = word[ends]
    mine_before = np.where(head, 1, np.r_[1, mine_word[:-1]] - (before == last[own.text]))  # a text's last word precedes none
    for m, minus in enumerate((np.ones(len(flags), np.int64), flags)):
        each = minus[own.text]
        total = np.maximum(totals[m] - minus * own.counts, 0)[own.text]
        p = (np.maximum(sums[m][word] - each * mine_word, 0) + UNIFORM) / (total + UNIFORM * size)
        c = np.maximum(sums[m][pair] - each * mine_pair, 0)
        k = np.maximum(np.maximum(sums[m][before] - each * mine_before, 0), c)
        loss = -np.log((c + SHRINK * p) / (k + SHRINK))
        out[m] = np.bincount(own.text, weights=loss, minlength=len(own.counts)) / np.maximum(own.counts, 1)
    return out


def score_own(docs: DataFrame, target: DataFrame, tokens: int = OWN_CHUNK, keys: int = RANGE) -> DataFrame:
    """score() by the matched models of docs itself; tokens: of a chunk, keys: of a range, about."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks, ranges = (max(1, -(-size // (TOKEN_BYTES * n))) for n in (tokens, keys))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk")
    texts = flagged(docs, target).select(chunk, F.col("doc_id").cast("long").alias("key"), F.col("target").cast("long").alias("b"), "text")
    sent = texts.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_sent(ranges), "range int, chunk int, keys binary, b binary, t binary")
    sums = stored(sent.repartition("range").sortWithinPartitions("range").mapInArrow(_summed(ranges), SUMS), "lm-sums")
    release(docs.sparkSession)
    of_words = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "b", "t")]).first()
    vocabulary, totals = of_words[0] + 1, (float(of_words[1]), float(of_words[2]))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids, flags, own, packs in _chunks(batches, "sums"):
            both = [(p[8 : 8 + n], p[8 + n :]) for p in packs for n in (int.from_bytes(p[:8], "little"),)]
            known = np.stack([np.concatenate([_counts(x) for x in y]) for y in zip(*both)]) if both else np.zeros((2, 0), np.int64)
            background, target_loss = _own_losses(own, flags, known, vocabulary, totals)
            empty = own.counts == 0
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(own.counts), pa.array(target_loss, mask=empty), pa.array(background, mask=empty),
                    pa.array(np.where(empty, 0.0, target_loss - background)), pa.array(flags == 1),
                ],
                [x.split()[0] for x in SCORES.split(", ")],
            )

    none = F.lit(None)
    rows = texts.select("*", none.cast("int").alias("range"), none.cast("binary").alias("sums"))
    back = sums.select("chunk", none.cast("long").alias("key"), none.cast("long").alias("b"), none.cast("string").alias("text"), "range", "sums")
    rows = rows.unionByName(back).repartition("chunk").sortWithinPartitions("chunk", "range")
    return rows.mapInArrow(scored, SCORES)
