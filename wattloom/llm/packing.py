"""Sequence packing by cutting-stock column generation (operator 8).

A document's tokens (its ids and one end id) are cut into as many full pieces of the sequence length as it has, and one
rest. Lengths are rounded up to classes of ``STEP`` tokens; the histogram of classes is the demand of a cutting-stock
problem, whose linear program is solved on the driver by column generation: a dense simplex basis of one pattern for
each class, new patterns priced by knapsack dynamic programming over the dual values. The driver holds the histogram
only, whose size depends on length and STEP, not on the corpus.

Pattern counts are rounded down; what is left of the demand is filled greedily, longest class first. Then pieces are
ranked within their class (exactly, by counts of salted buckets, so no task holds a class) and each rank has its place
in one copy of a pattern: its sequence and its slot. Offsets are sums over the earlier slots of the sequence.

Nulls: a null text is empty and has the end id only. A null doc_id is kept. Repeated rows are packed once each. Empty
tables give no pieces. Other columns are not read.
"""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import short_batches, slices, stored

#: Fixed by the query's contract: tokens of a sequence and the id that ends a document.
LENGTH, END = 2048, 1
#: Tokens of a length class.
STEP = 16
#: The program counts as solved once no pattern would lower its value by more than this share.
TOLERANCE = 1e-3
#: Pieces that one ranking bucket holds about.
RANKED = 200_000
#: The byte-level pre-tokenizer's published pattern; fixed by the vocabulary file.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_BLANKS = re.compile(r"\s\s").search
#: A run of white space that is too long for a look-ahead to be tried from its end backwards.
_LONG_RUN = re.compile(r"\s{50000}").search


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, equal to the tokenizer's own.

    The same vocabulary is also read as ranks, which encodes faster. The pre-tokenizer's look-ahead matters only where two
    white-space characters meet; other texts are split by the pattern without it, several times faster. Without the file
    of ranks, and for texts that hold the string of a special token or a very long run of white space, the tokenizer
    itself encodes."""

    def __init__(self, path: str, ranks: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer, self.exact = Tokenizer.from_file(path), None
        spec = json.loads(self.tokenizer.to_str())
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        kind = spec["pre_tokenizer"] or {}
        plain = (kind.get("type"), kind.get("add_prefix_space"), kind.get("use_regex")) == ("ByteLevel", False, True)
        if ranks and plain and not spec["normalizer"]:
            import tiktoken

            with open(ranks, "rb") as lines:
                merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            own = {"mergeable_ranks": merges, "special_tokens": {}}
            self.exact = tiktoken.Encoding("exact", pat_str=PIECES, **own)
            self.simple = tiktoken.Encoding("simple", pat_str=PIECES.replace(r"|\s+(?!\S)", ""), **own)

    def __call__(self, text: str) -> bytes:
        if self.exact is None or any(x in text for x in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        way = self.simple
        if _BLANKS(text):
            if _LONG_RUN(text):
                return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            way = self.exact
        return way.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        _ENCODERS[path] = Encoder(path, ranks if os.path.exists(ranks) else None)
    return _ENCODERS[path]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces_of(docs: DataFrame, name: str = "byte_bpe_50k.json", length: int = LENGTH, end: int = END) -> DataFrame:
    """PIECE rows: each document's tokens cut into full pieces and one rest. No shuffle."""
    last = np.array([end], "<u4").tobytes()
    short_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path(name))
        copies: dict[bytes, list[tuple]] = {}  # a copy within a task is encoded once
        for b in slices(batches):
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                text = text or ""
                digest = xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))
                rows = copies.get(digest)
                if rows is None:
                    raw = encode(text) + last
                    n = len(raw) // 4
                    rows = [(s, min(length, n - s), zlib.crc32(raw[4 * s : 4 * (s + length)]), n) for s in range(0, n, length)]
                    if len(copies) < 100_000:
                        copies[digest] = rows
                out.extend((doc_id, *r) for r in rows)
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [x.split()[0] for x in PIECE.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECE)


def _price(duals: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern with the largest sum of duals. size ascends."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(size, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if m := fits[c]:
            gain = duals[:m] + best[c - size[:m]]
            k = int(gain.argmax())
            if gain[k] > best[c] + 1e-12:
                best[c], pick[c] = gain[k], k
    pattern, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if pick[c] >= 0:
            pattern[pick[c]] += 1
            c -= size[pick[c]]
        else:
            c -= 1
    return float(best[capacity]), pattern


def plan(demand: np.ndarray, rounds: int = 1500) -> list[tuple[int, np.ndarray]]:
    """(copies, pattern) that hold demand[k] pieces of class k + 1 each; a pattern's classes sum to len(demand) at most."""
    capacity, there = len(demand), np.flatnonzero(demand)
    size, need = there + 1, demand[there].astype(float)
    if not len(there):
        return []
    need = need * (1 + 1e-9 * np.arange(len(need)))  # against cycling
    basis = np.diag(capacity // size).astype(float)  # column j: pattern j
    inverse = np.diag(1 / np.diag(basis))
    amount = inverse @ need
    for turn in range(rounds):
        if turn % 100 == 99:
            inverse = np.linalg.inv(basis)
            amount = inverse @ need
        value, pattern = _price(np.maximum(inverse.sum(0), 0), size, capacity)
        column = inverse @ pattern
        up = column > 1e-9
        if value <= 1 + TOLERANCE or not up.any():
            break
        ratio = np.where(up, np.maximum(amount, 0) / np.where(up, column, 1), np.inf)
        out = int(np.argmin(ratio))
        amount -= ratio[out] * column
        amount[out] = ratio[out]
        basis[:, out] = pattern
        row = inverse[out] / column[out]
        inverse -= np.outer(column, row)
        inverse[out] = row
    left = demand[there].astype(np.int64)
    plans: list[tuple[int, np.ndarray]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        held = pattern > 0
        times = min(times, int((left[held] // pattern[held]).min())) if held.any() else 0
        if times > 0:
            left[:] -= times * pattern
            whole = np.zeros(capacity, np.int64)
            whole[there] = pattern
            plans.append((times, whole))

    for j in range(len(there)):
        use(np.round(basis[:, j]).astype(np.int64), int(np.floor(amount[j] + 1e-6)))
    while left.any():  # longest first, then whatever fits, in as many copies as the demand allows
        pattern, room = np.zeros(len(there), np.int64), capacity
        for k in range(len(there) - 1, -1, -1):
            take = int(min(left[k], room // size[k]))
            pattern[k] += take
            room -= take * size[k]
        use(pattern, int(left.sum()))
    return plans


def placed(pieces: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """pieces (stored PIECE rows) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = pieces.withColumn("_class", F.ceil(F.col("length") / step).cast("int"))
    total = pieces.count()
    salts = max(1, -(-total // RANKED))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    counts = pieces.groupBy("_class", "_salt").agg(F.count(F.lit(1)).alias("n"))
    # classes x salts rows: a few hundred for each RANKED pieces
    before = counts.select(
        F.col("_class"), F.col("_salt"),
        (F.sum("n").over(Window.partitionBy("_class").orderBy("_salt")) - F.col("n")).alias("_before"),
    )
    histogram = {r["_class"]: r["n"] for r in counts.groupBy("_class").agg(F.sum("n").alias("n")).collect()}
    demand = np.array([histogram.get(k + 1, 0) for k in range(-(-length // step))], np.int64)
    rows, sequence = [], 0
    taken = np.zeros(len(demand), np.int64)
    slots: dict[int, list[tuple]] = {}
    for times, pattern in plan(demand):
        slot = 0
        for k in np.flatnonzero(pattern)[::-1].tolist():
            each = int(pattern[k])
            slots.setdefault(k + 1, []).append((int(taken[k]), sequence, each, slot))
            taken[k] += times * each
            slot += each
        sequence += times
    runs = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "sequence", "each", "slot")]))
    rows = pa.table({
        "_c": pa.array(list(slots), pa.int32()),
        "_runs": pa.array([[dict(zip(("first", "sequence", "each", "slot"), x)) for x in v] for v in slots.values()], runs),
    })  # as an Arrow table: a list of rows would start Python on executors, in a pool of its own
    runs = F.broadcast(spark.createDataFrame(rows))  # one row a class, at most as many runs as patterns
    window = Window.partitionBy("_class", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = pieces.withColumn("_rank", F.row_number().over(window) - 1).join(F.broadcast(before) if salts < 1000 else before, ["_class", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_before")).join(runs, F.col("_class") == F.col("_c"))
    run = F.element_at(F.filter("_runs", lambda x: x["first"] <= F.col("_rank")), -1)
    ranked = ranked.withColumn("_run", run).withColumn("_at", F.col("_rank") - F.col("_run.first"))
    ranked = ranked.select(
        *[x.split()[0] for x in PIECE.split(", ")],
        (F.col("_run.sequence") + F.floor(F.col("_at") / F.col("_run.each"))).alias("sequence_id"),
        (F.col("_run.slot") + F.col("_at") % F.col("_run.each")).alias("_slot"),
    )
    own = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return ranked.withColumn("offset", F.sum("length").over(own) - F.col("length")).drop("_slot")


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", length: int = LENGTH, end: int = END) -> DataFrame:
    """All pieces of all documents (doc_id, text) with their sequence and offset."""
    return placed(stored(pieces_of(docs, name, length, end), "pieces"), length)
