"""Alignment of two tokenizers by an event sweep (operator 13).

Tokenizer A reads a blank and the text, tokenizer B the text, before which it puts a blank itself; so both spell the same
bytes. One map encodes each text by both and emits the union of their end events, in blocks: a block holds the ids of
consecutive tokens of one side and the byte where they begin; the ends are the running sum of the ids' byte lengths.
Blocks are repartitioned by document and sorted within partitions by document and offset, and streamed through a state
machine whose state is what no common end has closed yet: a block or two of either side, whatever a document's length.
Where ends of both sides meet, a group closes and its last A and B tokens are linked.

Pairs of ids are counted over the corpus, by partial sums, from pairs that are already distinct within a document; the
counts (their number is bounded by the vocabularies, measured before a broadcast) come back to the documents by a join.

Nulls: a null or empty text has no tokens, like one that either tokenizer doesn't spell back byte by byte. A null doc_id
is kept. Repeated rows are aligned once each, and each counts. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, discard, sized, slices, stored
from .packing import Encoder, tokenizer_path

#: Tokens of a block of events; distinct pairs of a document that one row holds about.
BLOCK, PAIRS = 4096, 65_536
#: Sides of events: the document itself, tokens of A, tokens of B.
HEAD, A, B = 0, 1, 2

EVENTS = "key long, doc_id long, at long, side int, ids binary"
SWEPT = "key long, doc_id long, n_a long, n_b long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,n:long>>"  # a row's pairs are distinct


def gathered(table: np.ndarray, ids: np.ndarray) -> bytes:
    """The joined bytes of table (an array of bytes objects) at ids."""
    return b"".join(table[ids].tolist())


def byte_level() -> dict[str, int]:
    """The published map of byte-level vocabularies: printable characters are themselves, others follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class SideA:
    """Ids and token bytes of a byte-level vocabulary; strings of special tokens are ordinary text."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        self.encoder = Encoder(path, ranks if os.path.exists(ranks) else None)
        self.encoder.special = []
        self.encoder.tokenizer.encode_special_tokens = True
        decode, vocab = byte_level(), self.encoder.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(decode[c] for c in token) if all(c in decode for c in token) else token.encode()
        self.table = np.array(self.bytes, object)

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encoder(" " + text), "<u4")


class SideB:
    """Ids and token bytes of a sentencepiece model, which puts a blank before a text by itself."""

    def __init__(self, name: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:-1], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.table = np.array(self.bytes, object)

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(array("I", self.model.encode(text, num_threads=1)), "<u4")


_SIDES: dict[str, SideA | SideB] = {}


def side(name: str) -> SideA | SideB:
    if name not in _SIDES:
        _SIDES[name] = SideB(name) if name.endswith(".model") else SideA(name)
    return _SIDES[name]


def events_of(docs: DataFrame, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """EVENTS: for each row a head and, if both sides spell the text, the blocks of its A and B tokens. No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two, pack = side(a), side(b), zstandard.ZstdCompressor(level=1)
        length = {A: np.array([len(x) for x in one.bytes]), B: np.array([len(x) for x in two.bytes])}
        key = TaskContext.get().partitionId() << 40
        for part in slices(batches, 128):
            out: list[tuple] = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                key += 1
                out.append((key, doc_id, -1, HEAD, None))
                if not text:
                    continue
                ids = {A: one(text), B: two(text)}
                whole = b" " + text.encode()
                spelt = (gathered(t.table, ids[s]) for s, t in ((A, one), (B, two)))
                if any(x != whole for x in spelt):
                    continue
                for s, tokens in ids.items():
                    starts = np.cumsum(length[s][tokens]) - length[s][tokens]
                    out.extend(
                        (key, doc_id, int(starts[i]), s, pack.compress(tokens[i : i + block].astype("<u2").tobytes()))
                        for i in range(0, len(tokens), block)
                    )
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
                names = [x.split()[0] for x in EVENTS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.select("doc_id", "text").mapInArrow(encode, EVENTS)


class Sweep:
    """The state machine of one document: tokens come in blocks by offset, groups and links leave as ends meet."""

    def __init__(self, one: SideA, two: SideB):
        text = [[b"%d" % i for i in range(len(t.bytes))] for t in (one, two)]
        #: What a token writes: of A after a comma, a semicolon (it opens a group) or nothing; of B after a comma or a bar.
        self.spell = [[p + x for x in t] for t, marks in zip(text, ((b",", b";"), (b",", b"|"))) for p in marks]
        self.base = np.cumsum([0, *map(len, self.spell)])
        self.spell = np.array([x for part in self.spell for x in part], object)
        self.length = {A: np.array([len(x) for x in one.bytes]), B: np.array([len(x) for x in two.bytes])}
        self.start(None, None)

    def start(self, key, doc_id) -> None:
        none = np.zeros(0, np.int64)
        self.key, self.doc_id = key, doc_id
        self.ids, self.ends, self.last = {A: none, B: none}, {A: none, B: none}, {A: 0, B: 0}
        self.n = {A: 0, B: 0}
        self.links, self.hash, self.pairs = 0, hashlib.sha256(), np.zeros(0, np.uint32)
        self.times = np.zeros(0, np.int64)

    def take(self, s: int, ids: np.ndarray) -> None:
        """One block of side s; closes the groups whose end both sides have reached."""
        ends = self.last[s] + np.cumsum(self.length[s][ids])
        self.last[s], self.n[s] = int(ends[-1]), self.n[s] + len(ids)
        self.ids[s], self.ends[s] = np.r_[self.ids[s], ids], np.r_[self.ends[s], ends]
        at = np.searchsorted(self.ends[B], self.ends[A])
        i = np.flatnonzero(np.r_[self.ends[B], -1][at] == self.ends[A])
        if not len(i):
            return
        j = at[i]
        a, b = self.ids[A][: i[-1] + 1], self.ids[B][: j[-1] + 1]
        # groups: A tokens up to i[g], B tokens up to j[g]; where each token stands among the tokens of both sides
        first_a, first_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        first_a[np.r_[0, i[:-1] + 1]] = first_b[np.r_[0, j[:-1] + 1]] = True
        group_a, group_b = np.cumsum(first_a) - 1, np.cumsum(first_b) - 1
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + np.r_[0, j + 1][group_a]] = a + self.base[np.where(first_a, 1, 0)]
        code[np.arange(len(b)) + (i + 1)[group_b]] = b + self.base[np.where(first_b, 3, 2)]
        out = gathered(self.spell, code)
        self.hash.update(out if self.links else out[1:])
        self.links += len(i)
        self.add((a[i].astype(np.uint32) << np.uint32(16)) | b[j].astype(np.uint32), np.ones(len(i), np.int64))
        for side_, at in ((A, i), (B, j)):
            self.ids[side_], self.ends[side_] = self.ids[side_][at[-1] + 1 :], self.ends[side_][at[-1] + 1 :]

    def add(self, pairs: np.ndarray, times: np.ndarray) -> None:
        self.pairs, at = np.unique(np.r_[self.pairs, pairs], return_inverse=True)
        self.times = np.bincount(at, np.r_[self.times, times], len(self.pairs)).astype(np.int64)

    def flushed(self, done: bool) -> tuple:
        """A row of SWEPT, its pairs and their numbers apart: what has come so far and, if done, the document's figures."""
        pairs, times = self.pairs, self.times
        self.pairs, self.times = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not done:
            return (self.key, self.doc_id, 0, 0, 0, None, pairs, times)
        return (self.key, self.doc_id, self.n[A], self.n[B], self.links, self.hash.hexdigest() if self.n[A] else "", pairs, times)


def _swept_batch(rows: list[tuple]) -> pa.RecordBatch:
    *plain, pairs, times = zip(*rows)
    every = np.concatenate(pairs)
    fields = [(every >> 16).astype(np.int32), (every & 0xFFFF).astype(np.int32), np.concatenate(times)]
    links = pa.StructArray.from_arrays([pa.array(x) for x in fields], names=["a", "b", "n"])
    ends = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
    columns = [pa.array(c, pa.string() if k == 5 else pa.int64()) for k, c in enumerate(plain)]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, links)], names=[c.split()[0] for c in SWEPT.split(", ")])


def sweep(events: DataFrame, a: str, b: str, pairs: int = PAIRS) -> DataFrame:
    """SWEPT: one row with a hash for each document, and rows without for what its pairs need beyond about `pairs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, unpack, out = Sweep(side(a), side(b)), zstandard.ZstdDecompressor(), []
        for part in slices(batches, 64):
            for key, doc_id, s, ids in zip(*(part.column(c).to_pylist() for c in ("key", "doc_id", "side", "ids"))):
                if s == HEAD:
                    if state.key is not None:
                        out.append(state.flushed(True))
                    state.start(key, doc_id)
                    continue
                state.take(s, np.frombuffer(unpack.decompress(ids), "<u2").astype(np.int64))
                if len(state.pairs) >= pairs:
                    out.append(state.flushed(False))
            if sum(len(x[-1]) for x in out) > pairs or len(out) > 1000:
                yield _swept_batch(out)
                out = []
        if state.key is not None:
            out.append(state.flushed(True))
        if out:
            yield _swept_batch(out)

    dealt = events.repartition("key").sortWithinPartitions("key", "at", "side")
    return dealt.mapInArrow(run, SWEPT)


def align(
    docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", broadcast_rows: int = BROADCAST_ROWS,
    block: int = BLOCK, pairs: int = PAIRS,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each of docs(doc_id, text)."""
    swept = stored(sweep(events_of(docs, a, b, block), a, b, pairs), "swept")
    each = swept.select("key", F.explode("links").alias("x")).select("key", "x.*")
    counts = each.groupBy("a", "b").agg(F.sum("n").alias("count"))
    of_b = Window.partitionBy("b")  # at most one row for each A id: bounded by the vocabulary
    counts = stored(counts.withColumn("best", F.col("count") == F.max("count").over(of_b)), "pair-counts")
    found = each.join(sized(counts, broadcast_rows), ["a", "b"]).select(
        "key", (F.col("n") * F.col("count")).alias("count_sum"), F.when(F.col("best"), F.col("n")).otherwise(0).alias("n_best")
    )
    heads = swept.where("groups_sha256 is not null").drop("links")
    zero = F.lit(0).cast("long")
    rows = heads.withColumns({"count_sum": zero, "n_best": zero}).unionByName(found, allowMissingColumns=True)
    total = rows.groupBy("key").agg(
        F.max("doc_id").alias("doc_id"), *[F.coalesce(F.sum(c), zero).alias(c) for c in ("n_a", "n_b", "n_links", "n_best", "count_sum")],
        F.max("groups_sha256").alias("groups_sha256"),
    )
    groups = F.col("n_links").alias("n_groups")  # no token is empty, so a common end closes one group and makes one link
    return total.select("doc_id", "n_a", "n_b", groups, "n_links", "n_best", "count_sum", "groups_sha256")


def pair_counts(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    """(a, b, count): the linked id pairs of the corpus."""
    swept = stored(sweep(events_of(docs, a, b), a, b), "swept")
    pairs = swept.select(F.explode("links").alias("x")).groupBy("x.a", "x.b").agg(F.sum("x.n").alias("count"))
    out = stored(pairs, "pair-counts")
    discard(swept)
    return out
