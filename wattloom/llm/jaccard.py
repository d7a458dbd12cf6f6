"""Exact n-gram Jaccard join by parity sketches, and its connected components (operator 7).

A document's set holds 64-bit hashes of its distinct word 5-grams (the whole sequence, if it has fewer words). Equal sets
form a class (by a 64-bit hash of the set and its size); all work after that is on classes.

Two sets with similarity of 3/4 or more differ in at most D = (|A| + |B|) / 7 shingles. So:

* Parity sketch: every shingle toggles one bit of a sketch; the Hamming distance of two sketches is a lower bound of the
  symmetric difference, and pairs above D are dropped. A sketch has at least four bits for each shingle, which keeps
  the bound near the truth for long texts too; XORing its halves gives the sketch of half the width.
* Pigeonhole join, per size band (sizes from 4^k to 4^(k+1); a set that may have a partner in the next band also enters
  that one): shingles are dealt into cells and XORed within each. A differing shingle spoils one cell, so at most D
  cells differ, and in any fixed order of cells the first equal one is among the first D + 1 non-empty ones of either
  set. Only those are keys. Cells whose shingles are all frequent come last in that order, so boilerplate is a key only
  where nothing else is left. A set with D non-empty cells or fewer (small ones) adds prefix keys: in one fixed order
  its first |A| - ceil(3/4 |A|) + 1 shingles, of which any similar set shares one.
* Verify: exact intersection of the hashed sets.

Only components are asked for, so a bucket of classes with equal keys gives a star of pairs, not all pairs, and of
these each class is verified with the leader that looks nearest, of the LEADERS that it shares most buckets with, and
again with the nearest that it is not joined to. Where a bucket still holds several components after that, its classes
outside the largest of them are held against all others, by coarse sketches (a quarter of the width) in blocks of bounded
size, then by whole ones. What passes is verified: at first the nearest few of each class, which mostly joins it, then,
in buckets where more has passed, all that still lies across components. So no link that could join two components stays
untested. A pair that shares several buckets is tested in the first of them (as far as the KEPT lowest buckets of both
tell).

Nulls: null or empty text (also only white space) has an empty set, and its component is its own doc_id. A null doc_id
takes part, but is never the smallest of a component that has others. Repeated rows are copies. Extra columns are not
read. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, release, shielded, short_batches, sized, slices, stored, trim
from .components import components

#: Words of a shingle; at least this similarity (as a fraction NUM / DEN).
WIDTH, NUM, DEN = 5, 3, 4
#: Least bits of a parity sketch, and bits for each shingle.
LEAST_BITS, SHINGLE_BITS = 512, 4
#: Leaders that a class is compared with, and rounds of verifying the nearest of them.
LEADERS, ROUNDS = 6, 2
#: Of what a class may link with in a block, pairs that are tested before all are.
NEAREST = 2
#: 64-bit words that a coarse sketch has at least, or all of a shorter one.
COARSE = 16
#: Lowest buckets of a class that travel with it, and 64-bit words of sketches that a block holds about.
KEPT, BLOCK = 4, 100_000
#: A shingle is frequent if it is in at least this many classes and this share of them. The list is bounded by mean set
#: size / HOT_SHARE, whatever the corpus. Only the order of keys depends on it, never the result.
HOT_LEAST, HOT_SHARE, HOT_BITS = 40, 0.0005, 24
#: Pairs that one task verifies against the same centre.
STAR = 500
MEMBERS = "row long, doc_id long, n long, cls long, bits array<long>, df long"
_M1, _M2, _K = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: Random 64-bit values of bytes (A-Z like a-z), powers of an odd base and of its inverse: rolling hashes of words.
_rng = np.random.default_rng(7)
_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_BASE = 0x9FB21C651E98DF25
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        both = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, x, np.uint64)]) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        _POWERS[:] = both
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words (what blanks and \\t\\n\\v\\f\\r separate), A-Z lower-cased, in order."""
    x = np.frombuffer(raw, np.uint8)
    gap = np.empty(len(x) + 2, bool)
    gap[0] = gap[-1] = True
    np.take(_BLANK, x, out=gap[1:-1])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    power, back = _powers(len(x) + 1)
    total = np.empty(len(x) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[x] * power[: len(x)], out=total[1:])
    return mix((total[end] - total[start]) * back[start])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text."""
    h = word_hashes(text.encode("utf-8", "surrogatepass")) if text else ()
    n = len(h)
    if not n:
        return np.empty(0, np.uint64)
    k = min(WIDTH, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : n - k + 1 + i]
        out *= _K
        out ^= out >> np.uint64(29)
    out = mix(out)
    out.sort()
    return out[np.r_[True, out[1:] != out[:-1]]]


def class_of(s: np.ndarray) -> int:
    """Signed 64-bit id of a set: of the XOR and the sum of its hashes and its size."""
    total = s.sum(dtype=np.uint64)
    two = mix(np.array([total + np.uint64(len(s))]))
    return int(mix(two ^ np.bitwise_xor.reduce(s)).view(np.int64)[0])


def parity(s: np.ndarray) -> np.ndarray:
    width = max(LEAST_BITS, 1 << (SHINGLE_BITS * len(s) - 1).bit_length())
    bits = np.bincount(((s >> np.uint64(20)) & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def hot_table(hot: np.ndarray) -> np.ndarray:
    """Flags by the highest bits of a shingle: whether a frequent one has them."""
    table = np.zeros(1 << HOT_BITS, bool)
    table[hot >> np.uint64(64 - HOT_BITS)] = True
    return table


def keys_of(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """The sorted set's join keys, for its own size band and, if a partner may be there, the next. hot: hot_table()."""
    n = len(s)
    most = n * DEN // NUM
    differ = (n + most) // 7
    band = (n.bit_length() - 1) // 2
    late = hot[s >> np.uint64(64 - HOT_BITS)]
    top, one = np.uint64(63), np.uint64(1)
    out = []
    for k in (band, band + 1) if most >= 4 ** (band + 1) else (band,):
        cells = np.uint64(max(8, 4 ** (k + 1) // 2))
        cell = ((s >> np.uint64(32)) * cells) >> np.uint64(32)  # ascends with s
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        folded = np.bitwise_xor.reduceat(s, starts)
        key = mix(folded + cell[starts] * _K + np.uint64(k + 1)) >> one
        key |= np.logical_and.reduceat(late, starts).astype(np.uint64) << top  # frequent ones last
        if len(key) > differ + 1:
            key = np.partition(key, differ)[: differ + 1]
        out.append(key)
        if len(starts) <= differ:
            prefix = n - -(-n * NUM // DEN) + 1
            ranked = mix(s * _M1 + np.uint64(k + 77)) >> one
            ranked |= late.astype(np.uint64) << top
            out.append(np.sort(ranked)[:prefix])
    return np.concatenate(out)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, n, cls, bits, null), bits once a class and task; and (.., shingle, .., count) for what is frequent here."""
    names, kinds = [x.split()[0] for x in MEMBERS.split(", ")], [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int64()]
    seen: set[int] = set()
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        s = np.concatenate(held)
        bucket = (s >> np.uint64(43)).astype(np.int64)
        s = s[np.bincount(bucket, minlength=1 << 21)[bucket] >= 3]
        values, counts = np.unique(s, return_counts=True)
        keep = counts >= 3
        v, c = values[keep].view(np.int64), counts[keep]
        none = [None] * len(v)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((none, none, none, v, none, c), kinds)], names)

    for b in slices(batches):
        n, cls, bits = [], [], []
        for text in b.column("text").to_pylist():
            s = shingle_set(text)
            n.append(len(s))
            cls.append(class_of(s) if len(s) else None)
            bits.append(None)
            if len(s) and cls[-1] not in seen:
                seen.add(cls[-1])
                bits[-1] = parity(s)
                held.append(s)
                size += len(s)
        rows = (b.column("row"), b.column("doc_id").cast(pa.int64()), n, cls, bits, [None] * len(n))
        yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(rows, kinds)], names)
        if size > 1_000_000:
            yield frequent()
            held, size = [], 0
        if len(seen) > 2_000_000:
            seen.clear()
    if held:
        yield frequent()
        held = []
    trim()


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, n, cls) sorted by all three: (bucket, leader, cls, n); equal buckets once a task.

    A bucket is a run of classes of one key whose sizes leave no gap that no link can cross; its smallest class (by hash, so
    any of them) leads it."""
    names = ["bucket", "leader", "cls", "n"]
    seen: set[int] = set()
    rest = tuple(np.empty(0, np.int64) for _ in range(3))
    long_key, lead = None, 0  # of a key with too many classes to hold: its rows go out as they come, as one bucket

    def packed(bucket: np.ndarray, leader: np.ndarray, cls: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (bucket, leader, cls, n)], names)

    def streamed(n: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        return packed(np.full(len(c), long_key), np.full(len(c), lead), c, n)

    def whole(k: np.ndarray, n: np.ndarray, c: np.ndarray) -> pa.RecordBatch | None:
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (DEN * n[:-1] < NUM * n[1:])])
        sizes = np.diff(np.r_[starts, len(k)])
        many = sizes > 1
        if not many.any():
            return None
        row = np.repeat(many, sizes)
        n, c = n[row], c[row]
        sizes, starts = sizes[many], np.r_[0, np.cumsum(sizes[many])[:-1]]
        mark = np.bitwise_xor.reduceat(mix(c.view(np.uint64)), starts) + sizes.astype(np.uint64)
        mark = mark.view(np.int64)
        _, first = np.unique(mark, return_index=True)
        fresh = np.zeros(len(mark), bool)
        fresh[[i for i in first if int(mark[i]) not in seen]] = True
        seen.update(mark[fresh].tolist())
        if len(seen) > 2_000_000:
            seen.clear()
        row = np.repeat(fresh, sizes)
        if not row.any():
            return None
        leader = np.repeat(np.minimum.reduceat(c, starts), sizes)
        return packed(np.repeat(mark, sizes)[row], leader[row], c[row], n[row])

    for b in batches:
        if not b.num_rows:
            continue
        k, n, c = (np.r_[old, b.column(i).to_numpy(zero_copy_only=False).astype(np.int64)] for i, old in enumerate(rest))
        fresh = np.r_[True, (k[1:] != k[:-1]) | (c[1:] != c[:-1])]
        k, n, c = k[fresh], n[fresh], c[fresh]
        if long_key is not None:
            own = k == long_key
            if own.any():
                yield streamed(n[own], c[own])
            k, n, c = k[~own], n[~own], c[~own]
            if not len(k):
                rest = (k, n, c)
                continue
            long_key = None
        cut = int(np.searchsorted(k, k[-1]))
        if cut and (out := whole(k[:cut], n[:cut], c[:cut])):
            yield out
        rest = (k[cut:], n[cut:], c[cut:])
        if len(rest[0]) > 200_000:
            long_key, lead = int(rest[0][0]), int(rest[2].min())
            yield streamed(*rest[1:])
            rest = tuple(x[:0] for x in rest)
    if len(rest[0]) and (out := whole(*rest)):
        yield out
    trim()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (text, cls, roles): (leader, salt, cls, items) for each role of a row whose text has that class."""
    for b in slices(batches):
        out: list[tuple] = []
        for text, cls, roles in zip(b.column("text").to_pylist(), b.column("cls").to_pylist(), b.column("roles").to_pylist()):
            s = shingle_set(text)
            if len(s) and class_of(s) == cls:
                out.extend((r["leader"], r["salt"], cls, s.tobytes()) for r in roles)
        cols = list(zip(*out)) if out else [()] * 4
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["leader", "salt", "cls", "items"])


def _linked(table: pa.Table) -> pa.Table:
    """Classes of one (leader, salt) that link with the leader."""
    rows = dict(zip(table.column("cls").to_pylist(), table.column("items").to_pylist()))
    leader = table.column("leader")[0].as_py()
    base = np.frombuffer(rows.get(leader, b""), np.uint64)
    hits = []
    for cls, items in rows.items():
        s = np.frombuffer(items, np.uint64)
        if cls != leader and len(s) and len(base):
            at = np.minimum(np.searchsorted(base, s), len(base) - 1)
            both = int((base[at] == s).sum())
            if DEN * both >= NUM * (len(s) + len(base) - both):
                hits.append(cls)
    return pa.table({"a": pa.array([leader] * len(hits), pa.int64()), "b": pa.array(hits, pa.int64())})


def _fold(bits: Column) -> Column:
    """A parity sketch of half the width."""
    m = (F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), m), F.slice(bits, m + 1, m), lambda p, q: p.bitwiseXOR(q))


def _apart(x: Column, y: Column) -> Column:
    """Hamming distance of two parity sketches of equal or half width."""
    same = lambda v, w: F.when(F.size(v) > F.size(w), _fold(v)).otherwise(v)
    return F.aggregate(F.zip_with(same(x, y), same(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, d: s + d)


def _close(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """pairs(a, b) whose sizes and parity sketches, first coarse, then whole, allow a link; with their distance and the size of b."""
    for bits in ("coarse", "bits"):
        for side in "ab":
            pairs = pairs.join(classes.select(F.col("cls").alias(side), F.col("n").alias(f"n_{side}"), F.col(bits).alias(f"bits_{side}")), side)
        total = F.col("n_a") + F.col("n_b")
        fits = DEN * F.least("n_a", "n_b") >= NUM * F.greatest("n_a", "n_b")
        pairs = pairs.where(fits).withColumn("apart", _apart(F.col("bits_a"), F.col("bits_b"))).where(F.col("apart") * 7 <= total)
        pairs = pairs.select("a", "b", *([] if bits == "coarse" else ["apart", F.col("n_b").alias("n")]))
    return pairs


def _crossing(most: int | None):
    """From rows sorted by (bucket, i, j): (bucket, a, b, more), pairs across components that sizes and coarse sketches allow.

    A group holds a block of rows outside the bucket's largest component (side 0) and a block of all rows (side 1 for those
    of the largest component, else 2). most: of a row's pairs in a group only so many, the nearest looking; more tells that
    there are others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for b in batches:
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            keys = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "i", "j")])
            starts = np.r_[0, np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1, b.num_rows]
            if b.num_rows:
                yield _tested(b, starts[:-1], most)
                rest = b.slice(starts[-2])
        if rest is not None and rest.num_rows:
            yield _tested(rest, np.array([0, rest.num_rows]), most)
        trim()

    return run


def _tested(b: pa.RecordBatch, starts: np.ndarray, most: int | None) -> pa.RecordBatch:
    """_crossing() for the groups between consecutive starts."""
    plain = lambda c: b.column(c).to_numpy(zero_copy_only=False)
    bucket, cls, comp, n, side = map(plain, ("bucket", "cls", "comp", "n", "side"))
    bits, at = b.column("bits").values.to_numpy().view(np.uint64), b.column("bits").offsets.to_numpy()
    low, low_at = b.column("low").values.to_numpy(), b.column("low").offsets.to_numpy()
    out: list[tuple[np.ndarray, ...]] = []
    for g, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
        own = np.arange(g, e)
        left, right = own[side[g:e] == 0], own[side[g:e] > 0]
        if not len(left) or not len(right):
            continue
        once = side[right] == 1  # other pairs are met from both ends
        width = np.diff(at)[right]
        tables = {w: bits[at[right[width == w]][:, None] + np.arange(w)] for w in np.unique(width).tolist()}
        lows = [low[low_at[r] : low_at[r + 1]] for r in right.tolist()]
        lows, owner = np.concatenate(lows), np.repeat(np.arange(len(right)), [len(x) for x in lows])
        for x in left.tolist():
            ok = (comp[right] != comp[x]) & (DEN * np.minimum(n[right], n[x]) >= NUM * np.maximum(n[right], n[x]))
            ok &= once | (cls[right] > cls[x])
            earlier = low[low_at[x] : low_at[x + 1]]
            ok[owner[np.isin(lows, earlier[earlier < bucket[x]])]] = False
            own_bits = bits[at[x] : at[x + 1]]
            hits, gaps = [], []
            for w, table in tables.items():
                here = np.flatnonzero(width == w)
                some = ok[here]
                if not some.any():
                    continue
                y, z = table[some], own_bits
                if w > len(z):
                    y = y[:, : len(z)] ^ y[:, len(z) :]
                elif w < len(z):
                    z = z[:w] ^ z[w:]
                apart = np.bitwise_count(y ^ z).sum(1, dtype=np.int64)
                hit = right[here[some]]
                fits = apart * 7 <= n[hit] + n[x]
                hits.append(hit[fits])
                gaps.append(apart[fits])
            if hits and len(hit := np.concatenate(hits)):
                more = most is not None and len(hit) > most
                hit = hit[np.argsort(np.concatenate(gaps), kind="stable")[:most]] if more else hit
                out.append((np.full(len(hit), bucket[x]), np.full(len(hit), cls[x]), cls[hit], np.full(len(hit), more)))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 3 + [np.empty(0, bool)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["bucket", "a", "b", "more"])


def _blocks(now: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """_crossing()'s rows of now(bucket, cls, n, comp), for buckets with several components, and the stored table they read.

    Rows outside a bucket's largest component are dealt into blocks i, all rows into blocks j, and each block meets each."""
    now = now.withColumn("w", F.greatest(F.col("n") / 32, F.lit(16)))  # words of a coarse sketch, at most
    of_bucket = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("k"), F.sum("w").alias("w"))
    home = of_bucket.groupBy("bucket").agg(
        F.max_by(F.struct("comp", "w"), F.struct("k", "comp")).alias("h"), F.count(F.lit(1)).alias("comps"), F.sum("w").alias("w")
    ).where("comps > 1")
    home = home.select(
        "bucket", F.col("h.comp").alias("home"), F.ceil((F.col("w") - F.col("h.w")) / BLOCK).cast("int").alias("is"), F.ceil(F.col("w") / BLOCK).cast("int").alias("js")
    )
    now = stored(now.drop("w").join(home, "bucket"), "mixed")
    low = now.groupBy("cls").agg(F.slice(F.array_sort(F.collect_list("bucket")), 1, KEPT).alias("low"))  # keys of one set
    salt, inner = F.xxhash64("cls", "bucket"), F.col("comp") != F.col("home")
    kept = ["bucket", "cls", "comp", "n"]
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    left = now.where(inner).select(*kept, F.pmod(salt, F.col("is")).cast("int").alias("i"), F.explode(upto("js")).alias("j"), F.lit(0).alias("side"))
    right = now.select(*kept, F.explode(upto("is")).alias("i"), F.pmod(salt, F.col("js")).cast("int").alias("j"), F.when(inner, 2).otherwise(1).alias("side"))
    wide = low.join(classes.select("cls", F.col("coarse").alias("bits")), "cls")
    return left.unionByName(right).join(wide, "cls"), now


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """Those of pairs(a, b) that link, by exact intersection, and the stored table that this reads."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).cast("int").alias("salts"))
    out = pairs.join(salts, "a")
    mine = out.select(F.col("b").alias("cls"), F.struct(F.col("a").alias("leader"), F.pmod(F.hash("b"), F.col("salts")).alias("salt")).alias("role"))
    lead = salts.select(F.col("a").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("leader"))
    roles = mine.unionByName(lead.select("cls", F.struct("leader", "salt").alias("role"))).groupBy("cls").agg(F.collect_set("role").alias("roles"))
    roles = stored(roles.join(classes.select("cls", F.col("doc_id").alias("_id")), "cls"), "roles")
    rows = docs.select("doc_id", "text").join(sized(roles, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("_id")))
    sets = rows.select("text", "cls", "roles").mapInArrow(_sets, "leader long, salt int, cls long, items binary")
    return sets.groupBy("leader", "salt").applyInArrow(_linked, "a long, b long"), roles


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, items: int, broadcast_rows: int) -> list[DataFrame]:
    """_verified() in parts, stored one by one: each moves about half as many hashes as all sets hold (items), at most."""
    moved = pairs.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-2 * moved // max(items, 1)))
    out = []
    for i in range(parts):
        found, roles = _verified(pairs.where(F.pmod(F.xxhash64("a"), F.lit(parts)) == i), docs, classes, broadcast_rows)
        out.append(stored(found, "links"))
        discard(roles)
        release(docs.sparkSession)
    return out


def _grouped(docs: DataFrame, broadcast_rows: int) -> tuple[DataFrame, DataFrame]:
    """(members: row, doc_id, n, cls of each row of docs(row, doc_id, text), labels: node, comp of linked classes), both stored."""
    spark = docs.sparkSession
    short_batches(spark)
    rows = stored(docs.mapInArrow(_members, MEMBERS), "members")
    classes = rows.where("df IS NULL AND cls IS NOT NULL").groupBy("cls").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits")
    )
    w = F.size("bits")
    coarse = F.when(w <= COARSE, F.col("bits")).when(w <= 2 * COARSE, _fold(F.col("bits"))).otherwise(_fold(_fold(F.col("bits"))))
    classes = stored(classes.withColumn("coarse", coarse), "classes")
    members = stored(rows.where("df IS NULL").select("row", "doc_id", "n", "cls"), "members")
    least = max(HOT_LEAST, int(HOT_SHARE * classes.count()))
    hot = rows.where("df IS NOT NULL").groupBy("cls").agg(F.sum("df").alias("df")).where(F.col("df") >= least)
    hot = np.sort(hot.select("cls").toPandas()["cls"].to_numpy(np.int64).view(np.uint64))
    discard(rows)
    shared = spark.sparkContext.broadcast(hot)  # the list, not the table made of it

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table = hot_table(shared.value)
        for b in slices(batches):
            keys, ids, held = [], [], 0
            for text in b.column("text").to_pylist():
                s = shingle_set(text)
                if len(s) and (cls := class_of(s)) not in seen:
                    seen.add(cls)
                    keys.append(keys_of(s, table))
                    ids.append((cls, len(s), len(keys[-1])))
                    held += len(keys[-1])
                    if held > 200_000:
                        yield _flat(keys, ids)
                        keys, ids, held = [], [], 0
            if keys:
                yield _flat(keys, ids)
            if len(seen) > 2_000_000:
                seen.clear()
        del table
        trim()

    buckets = stored(
        docs.mapInArrow(keyed, "key long, n int, cls long").repartition("key").sortWithinPartitions("key", "n", "cls")
        .mapInArrow(_stars, "bucket long, leader long, cls long, n long").distinct(), "buckets",
    )
    release(spark)

    def across(df: DataFrame, *columns: str) -> DataFrame:
        """df with <column>_comp for each column of classes."""
        for c in columns:
            own = labels.select(F.col("node").alias(f"_{c}"), F.col("comp").alias(f"{c}_comp"))
            df = df.join(own, F.col(c) == F.col(f"_{c}"), "left").withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c)).drop(f"_{c}")
        return df

    shared_keys = buckets.where("leader <> cls").groupBy(F.col("leader").alias("a"), F.col("cls").alias("b")).agg(F.count(F.lit(1)).alias("k"))
    often = F.slice(F.sort_array(F.collect_list(F.struct("k", "a")), asc=False), 1, LEADERS)  # a class has few keys
    stars = shared_keys.groupBy("b").agg(often.alias("x")).select("b", F.explode("x").alias("x")).select("x.a", "b")
    stars = stored(_close(stars, classes), "stars")
    release(spark)
    items = classes.agg(F.sum("n")).first()[0] or 0
    tested = stars.select("a", "b").limit(0)
    labels = tested.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    parts, used = [], [stars]  # tables of links; of tested pairs
    for _ in range(ROUNDS):  # each class with the leader that looks nearest, of those it is not joined to
        left = across(stars.join(tested, ["a", "b"], "left_anti"), "a", "b").where("a_comp <> b_comp")
        best = left.groupBy("b").agg(F.min_by(F.struct("a", "n"), F.struct("apart", "a")).alias("p"))
        best = stored(best.select("p.a", "b", "p.n"), "pairs")
        used.append(best)
        tested = tested.unionByName(best.select("a", "b"))
        parts += _links(best, docs, classes, items, broadcast_rows)
        discard(labels)
        labels = components(reduce(DataFrame.unionByName, parts))
        release(spark)
    # what shares a bucket across components: first the nearest of each class, in the end all that is not tested yet
    live = buckets.select("bucket", "cls", "n").distinct()
    for most in (*[NEAREST] * ROUNDS, None):
        blocks, mixed = _blocks(across(live, "cls").withColumnRenamed("cls_comp", "comp"), classes)
        found = blocks.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(_crossing(most), "bucket long, a long, b long, more boolean")
        found = stored(found, "crossing")
        both = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b")))
        fresh = stored(found.select("a", "b").distinct().join(both, ["a", "b"], "left_anti"), "pairs")
        new = stored(_close(fresh, classes), "pairs")
        used += [fresh, new]
        tested = tested.unionByName(fresh)
        if new.limit(1).count():
            parts += _links(new, docs, classes, items, broadcast_rows)
            discard(labels)
            labels = components(reduce(DataFrame.unionByName, parts))
        again = found.where("more").select("bucket").distinct()
        left = again.limit(1).count() > 0
        last, live = live, stored(buckets.select("bucket", "cls", "n").distinct().join(again, "bucket", "left_semi"), "live") if left else None
        discard(mixed, found, last)
        release(spark)
        if not left:
            break
    discard(buckets, *used)
    discard(classes, *parts)
    release(spark)
    return members, labels


def _firsts(members: DataFrame, labels: DataFrame, first: Column) -> DataFrame:
    """(cls, first, rows): for classes of components with several rows, the smallest `first` of the component."""
    own = members.where("cls IS NOT NULL").groupBy("cls").agg(F.min(first).alias("m"), F.count(F.lit(1)).alias("k"))
    own = own.join(labels.select(F.col("node").alias("_n"), "comp"), F.col("cls") == F.col("_n"), "left").select("cls", "m", "k", F.coalesce("comp", "cls").alias("comp"))
    best = own.groupBy("comp").agg(F.min("m").alias("first"), F.sum("k").alias("rows")).where("rows > 1")
    return own.select("cls", "comp").join(best, "comp").select("cls", "first")


def link_groups(docs: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs (doc_id, text)."""
    docs = docs.select(F.lit(0).cast("long").alias("row"), "doc_id", "text")
    members, labels = _grouped(docs, broadcast_rows)
    firsts = stored(_firsts(members, labels, F.col("doc_id")), "firsts")
    discard(labels)
    out = members.join(sized(firsts, broadcast_rows), "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def _flat(keys: list[np.ndarray], ids: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cls, n, many = (np.array(x, np.int64) for x in zip(*ids))
    columns = np.concatenate(keys).view(np.int64), np.repeat(n, many).astype(np.int32), np.repeat(cls, many)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "n", "cls"])


def keep_one(docs: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (null ids last), then of the smallest text hash.

    Rows are told apart by doc_id and text, so rows that share an id but not a text are judged by themselves; of equal rows
    one stays. Rows with an empty set are linked with nothing and all stay."""
    docs, restore = shielded(docs, "doc_id", "text")
    docs = docs.withColumn("row", F.xxhash64("text"))
    members, labels = _grouped(docs.select("row", "doc_id", "text"), broadcast_rows)
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    out = members.join(sized(_firsts(members, labels, order), broadcast_rows), "cls")
    mine = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    rows = stored(out.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.max(mine).alias("stays"), F.count(F.lit(1)).alias("n")), "rows")
    discard(members, labels)
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    gone, twice = (sized(rows.where(x).select("_id", "_row"), broadcast_rows) for x in ("NOT stays", "stays AND n > 1"))
    left = docs.join(gone, same, "left_anti")
    if rows.where("stays AND n > 1").limit(1).count():
        left = left.join(twice, same, "left_anti").unionByName(docs.join(twice, same, "left_semi").dropDuplicates(["doc_id", "row"]))
    return restore(left)
