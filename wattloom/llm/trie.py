"""Prefix trie of conversations in preorder intervals (operator 12).

A conversation c is rebuilt from the first h turns of its block's first conversation and its own turns after its first h.
A node is a distinct sequence of first turns. It is known by its depth and 128 bits: the exclusive or of hashes of
(position, role, text), so all prefixes of a conversation come from one running exclusive or, whatever its length.

Nodes are ranked lexicographically by the hashes of their turns. Only turns below a node where paths part decide an order,
so the sort key of a distinct conversation holds those, one for each place where others leave its path. The conversations
that end in distinct nodes are ranked by it, and a node takes the least and largest rank below it: sorted by
(least rank, depth) nodes stand in preorder and a subtree is an interval. Leaves and saved tokens of a subtree are
differences of distributed prefix sums at the ends of the interval.

No task holds a conversation, a node's members or the trie: turns are dealt in ranges of (conversation, turn, role, text),
running values are carried from range to range by one small row for each, and members are joined to lists of ids in blocks
of their value, which one stream hashes in order.

Nulls: rows without conv_id belong to no conversation; a null turn comes first; a null role or text is empty. Turns that
tie are ordered by role, then text. Repeated rows are turns each. An empty table has no conversation and gives no rows, not
even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stored

#: Fixed by the query's contract: conversations of a block, and one more than turns that a conversation may take over.
BLOCK, SHARED = 20, 4
#: Words of a text; fixed by the query's contract.
SAVED_WORD = r"[^\x20\x09-\x0D]+"
#: Ids of members are joined in blocks of so many values.
MEMBERS = 4096
NODE = ["depth", "p1", "p2"]


def prefix_sums(df: DataFrame, order: list[Column], keep: list[str], values: list[str], name: str) -> DataFrame:
    """keep, `_pid` and, for each of values (0 or more each), `_<value>`: its sum up to and with this row in the order.

    Rows are dealt in ranges of the order and summed within; the sums of the ranges, one row for each, go to all."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    schema = T.StructType([
        *[T.StructField(c, kinds[c]) for c in keep], T.StructField("_pid", T.LongType()), *[T.StructField(f"_{v}", T.LongType()) for v in values],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, total = TaskContext.get().partitionId(), np.zeros(len(values), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            sums = [t + np.cumsum(b.column(v).to_numpy(zero_copy_only=False).astype(np.int64)) for t, v in zip(total, values)]
            total = np.array([s[-1] for s in sums])
            own = [b.column(c) for c in keep] + [pa.array(np.full(b.num_rows, pid))] + [pa.array(s) for s in sums]
            yield pa.RecordBatch.from_arrays(own, names=schema.names)

    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).select(*dict.fromkeys(keep + values))
    out = stored(dealt.mapInArrow(run, schema), name)
    sums = out.groupBy("_pid").agg(*[F.max(f"_{v}").alias(v) for v in values]).orderBy("_pid").collect()  # a row a partition
    before, rows = [0] * len(values), []
    for r in sums:
        rows.append((r["_pid"], *before))
        before = [x + r[v] for x, v in zip(before, values)]
    kind = "_p long, " + ", ".join(f"_b{i} long" for i in range(len(values)))
    carry = F.broadcast(out.sparkSession.createDataFrame(rows, kind))
    whole = out.join(carry, F.col("_pid") == F.col("_p"))
    return whole.select(*keep, "_pid", *[(F.col(f"_{v}") + F.col(f"_b{i}")).alias(f"_{v}") for i, v in enumerate(values)])


def _mark(d1: Column, d2: Column, at: Column) -> list[Column]:
    """128 bits of a turn at a position (from 1)."""
    at = at.cast("long")
    return [F.xxhash64(d1, d2, at), F.xxhash64(at, d2, d1)]


def rebuilt(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """(rows, convs) of the rebuilt conversations: rows (conv_id, depth, p1, p2, q1, q2, words, length), where p is the node
    that the turn reaches, q its parent, and convs (conv_id, length)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"), F.lit(1).alias("g"),
        F.xxhash64(F.lit(1), role, text).alias("d1"), F.xxhash64(F.lit(2), text, role).alias("d2"),
        F.regexp_count(text, F.lit(SAVED_WORD)).cast("long").alias("words"), F.monotonically_increasing_id().alias("salt"),
    )
    order = [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text"), F.col("salt")]
    dealt = prefix_sums(rows, order, ["conv_id", "d1", "d2", "words"], ["g"], "trie-turns")
    parts = stored(dealt.groupBy("conv_id", "_pid").agg(F.count(F.lit(1)).alias("n"), F.min("_g").alias("start")), "trie-parts")
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(block))
    convs = parts.groupBy("conv_id").agg(F.sum("n").alias("n"), F.min("start").alias("start"))
    convs = convs.withColumns({"base": base, "h": F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(shared))})
    bases = convs.where("conv_id = base").select(F.col("conv_id").alias("base"), F.col("n").alias("nb"))
    convs = convs.join(bases, "base", "left").withColumn("kept", F.least("h", F.coalesce("nb", F.lit(0))).cast("int"))
    convs = convs.withColumn("length", F.col("kept") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = stored(convs.select("conv_id", "base", "n", "start", "h", "kept", "length"), "trie-convs")

    info = parts.select("conv_id", "_pid").join(convs, "conv_id")
    own = dealt.join(info, ["conv_id", "_pid"]).withColumn("at", F.col("_g") - F.col("start"))
    own = stored(own.select("conv_id", "_pid", "base", "at", "d1", "d2", "words", "h", "kept", "length"), "trie-own")
    first = own.where((F.col("conv_id") == F.col("base")) & (F.col("at") < shared - 1))  # at most three rows each
    heads = first.groupBy("base").agg(F.array_sort(F.collect_list(F.struct("at", "d1", "d2", "words"))).alias("head"))

    def fold(upto: Column, k: int) -> Column:
        return F.aggregate(
            F.slice("head", F.lit(1), upto), F.lit(0).cast("long"), lambda sofar, e: sofar.bitwiseXOR(_mark(e["d1"], e["d2"], e["at"] + 1)[k])
        )

    with_head = stored(convs.where("kept > 0").join(heads, "base").select("conv_id", "kept", "length", "head"), "trie-heads")
    taken = F.transform(
        F.slice("head", F.lit(1), F.col("kept")),
        lambda e, j: F.struct(
            (j + 1).cast("long").alias("depth"), fold(j + 1, 0).alias("p1"), fold(j + 1, 1).alias("p2"),
            *[m.alias(c) for m, c in zip(_mark(e["d1"], e["d2"], e["at"] + 1), ("x1", "x2"))], e["words"].alias("words"),
        ),
    )
    head_rows = with_head.select("conv_id", "length", F.inline(taken))

    mark = _mark(F.col("d1"), F.col("d2"), F.col("depth"))
    own_rows = own.where("at >= h").withColumn("depth", F.col("at") - F.col("h") + F.col("kept") + 1).withColumns({"x1": mark[0], "x2": mark[1]})
    part = Window.partitionBy("conv_id", "_pid").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own_rows = stored(
        own_rows.withColumns({c: F.expr(f"bit_xor({x})").over(part) for c, x in (("p1", "x1"), ("p2", "x2"))})
        .select("conv_id", "_pid", "length", "depth", "p1", "p2", "x1", "x2", "words"), "trie-own-rows",
    )
    # what comes before a part: the turns taken over and the earlier parts of its conversation (at most one row a range)
    earlier = Window.partitionBy("conv_id").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carry = own_rows.groupBy("conv_id", "_pid").agg(F.expr("bit_xor(x1)").alias("t1"), F.expr("bit_xor(x2)").alias("t2"))
    carry = carry.select("conv_id", "_pid", *[F.coalesce(F.expr(f"bit_xor({t})").over(earlier), zero).alias(o) for t, o in (("t1", "o1"), ("t2", "o2"))])
    over = with_head.select("conv_id", *[fold(F.col("kept"), k).alias(f"h{k}") for k in (0, 1)])
    carry = carry.join(over, "conv_id", "left").select(
        "conv_id", "_pid", *[F.col(o).bitwiseXOR(F.coalesce(h, zero)).alias(o) for o, h in (("o1", "h0"), ("o2", "h1"))]
    )
    own_rows = own_rows.join(carry, ["conv_id", "_pid"])
    own_rows = own_rows.withColumns({p: F.col(p).bitwiseXOR(F.col(o)) for p, o in (("p1", "o1"), ("p2", "o2"))})
    parent = [F.col(p).bitwiseXOR(F.col(x)).alias(q) for p, x, q in (("p1", "x1", "q1"), ("p2", "x2", "q2"))]
    names = ["conv_id", "depth", "p1", "p2", *parent, "words", "length"]
    out = stored(head_rows.select(*names).unionByName(own_rows.select(*names)), "trie-rows")
    whole = stored(convs.select("conv_id", "length"), "trie-lengths")
    discard(dealt, parts, convs, own, with_head)
    return out, whole


def member_hashes(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256: SHA-256 of the decimal conv_ids of ends(NODE, conv_id), ascending, comma-joined.

    Ids are joined in blocks of MEMBERS values first; one stream a node hashes the blocks in order and holds one at a time."""
    schema = "depth long, p1 long, p2 long, ends_sha256 string"
    blocks = ends.groupBy(*NODE, F.floor(F.col("conv_id") / F.lit(MEMBERS)).alias("_block")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    blocks = blocks.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*NODE, "ends_sha256"])
        for b in batches:
            for *now, ids in zip(*(b.column(c).to_pylist() for c in (*NODE, "ids"))):
                if now == node:
                    state.update(b"," + ids.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = now, hashlib.sha256(ids.encode())
            if out:
                yield done()
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
            yield done()

    return blocks.repartition(*NODE).sortWithinPartitions(*NODE, "_block").mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, block: int = BLOCK, shared: int = SHARED) -> DataFrame:
    """One row a node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, preorder and subtree_end (the first and last place of its subtree in preorder, from 1)."""
    rows, convs = rebuilt(turns, block, shared)
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in NODE], "conv_id", "n_convs", *[F.lit(None).cast("long").alias(c) for c in ("q1", "q2")], zero.alias("words"))
    below = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.min("q1").alias("q1"), F.min("q2").alias("q2"), F.max("words").alias("words")
    )
    nodes = stored(root.unionByName(below), "trie-nodes")

    ends = rows.where("depth = length").select(*NODE, "conv_id")
    ends = ends.unionByName(convs.where("length = 0").select(*[zero.alias(c) for c in NODE], "conv_id"))
    ends = stored(ends, "trie-ends")
    tops = ends.groupBy(*NODE).agg(F.min("conv_id").alias("top"))
    parent = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.where("depth > 0").select(*parent).groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children"))
    nodes_of = nodes.join(children, NODE, "left").join(tops, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    full = stored(nodes_of, "trie-full")
    parts = (F.col("n_children") + F.col("top").isNotNull().cast("long") > 1).alias("parting")
    above = full.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"), parts)
    full_up = stored(full.join(above, ["depth", "q1", "q2"], "left"), "trie-up")

    # one conversation for each node in which some end; the turns of its path where others part from it
    paths = stored(rows.join(tops.select(F.col("top").alias("conv_id")), "conv_id", "left_semi").select("conv_id", *NODE), "trie-paths")
    signs = paths.join(full_up.where("parting").select(*NODE), NODE).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*NODE))).alias("path"))
    empty = F.array().cast("array<struct<depth:bigint,p1:bigint,p2:bigint>>")
    keys = tops.select(F.col("top").alias("conv_id")).join(signs, "conv_id", "left").select("conv_id", F.coalesce("path", empty).alias("path"), F.lit(1).alias("rank"))
    ranked = prefix_sums(keys, [F.col("path")], ["conv_id"], ["rank"], "trie-ranks").select("conv_id", F.col("_rank").alias("rank"))

    spans = paths.join(ranked, "conv_id").groupBy(*NODE).agg(F.min("rank").alias("first"), F.max("rank").alias("last"))
    all_of = ranked.agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first is not null").select(*[zero.alias(c) for c in NODE], "first", "last")
    shown = full_up.select(*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.lit(1).alias("place"))
    shown = shown.join(spans.unionByName(all_of), NODE)
    keep = [*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children", "leaf", "saved", "last", "first"]
    placed = prefix_sums(shown, [F.col("first"), F.col("depth")], keep, ["leaf", "saved", "place"], "trie-preorder")
    # the last node whose least rank is r closes every subtree whose largest rank is r
    closing = placed.groupBy(F.col("first").alias("last")).agg(*[F.max(f"_{v}").alias(f"end_{v}") for v in ("leaf", "saved", "place")])
    out = placed.join(closing, "last").join(member_hashes(ends), NODE, "left")
    total = [(F.col(f"end_{v}") - F.col(f"_{v}") + F.col(v)).alias(n) for v, n in (("leaf", "n_leaves"), ("saved", "saved_tokens"))]
    out = stored(out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *total, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        F.col("_place").alias("preorder"), F.col("end_place").alias("subtree_end"),
    ), "trie")
    discard(rows, convs, nodes, ends, full, full_up, paths)
    return out
