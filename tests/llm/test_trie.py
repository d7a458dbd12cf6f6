"""Operator 12 against a plain trie."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from wattloom.llm import trie
from wattloom.llm.queries import op12_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    own, members, ends, children = defaultdict(list), defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, of in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(of) - 1) * words
    return [
        (min(of), len(n), min(members[n[:-1]]) if n else None, len(of), len(children.get(n, ())), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest())
        for n, of in members.items()
    ]


def by_key(rows):
    return sorted(rows, key=lambda r: tuple(map(str, r)))


ROWS = [
    (None, 1, "user", "x"), (1000, None, None, None), (1001, 3, "a", "b"), (1001, None, "z", "q"), (1020, 1, "user", "one two"), (1021, 1, "user", "one two"),
    (1021, 2, "bot", "t"), (1022, 1, "user", "one two"), (1023, 1, "user", "zz"), (1033, 1, "u", "t"), (1033, 1, "u", "t"), (1033, 1, "u", "s"), (-3, 1, "u", "s"), (-20, 0, "u", "r"),
    *[(2000, i, "u", f"t{i % 7}") for i in range(300)], *[(2001, i, "u", f"t{i % 7}") for i in range(300)], *[(2002, i, "u", f"t{i % 7}") for i in range(200)],
    *[(2003, i, "u", f"t{i % 7}") for i in range(250)], (2003, 250, "u", "end\tx  y"), *[(3000 + i, 0, "u", "same first") for i in range(200)],
    *[(9_000 + 5_000 * i, 0, "u", "long " * 2000) for i in range(4)],
]


def test_trie(spark):
    from pyspark.sql import functions as F

    turns = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in ("depth", "p1", "words", "length", "_pid", "rank")}).repartition(5)
    got = trie.prefix_trie(turns)
    assert by_key(tuple(r)[:8] for r in got.collect()) == by_key(plain(ROWS))
    nodes = {r["preorder"]: r for r in got.collect()}
    assert sorted(nodes) == list(range(1, len(nodes) + 1)) and nodes[1]["subtree_end"] == len(nodes)
    for at, r in nodes.items():
        inside = [nodes[k] for k in range(at + 1, r["subtree_end"] + 1)]
        assert all(x["depth"] > r["depth"] for x in inside) and sum(x["depth"] == r["depth"] + 1 for x in inside) == r["n_children"]


def test_trie_query(spark, tmp_path):
    rows = ROWS[:12] + ROWS[-4:]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert by_key(map(tuple, op12_conversation_trie(spark, str(tmp_path)).collect())) == by_key(plain(rows))


@pytest.mark.parametrize("rows", [[], [(None, 1, "u", "t")]])
def test_trie_empty(spark, rows):
    assert trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).count() == 0
