"""Operator 13 against a plain alignment token by token."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest

from wattloom.llm import align
from wattloom.llm.queries import op13_alignment

ONE, TWO = "byte_bpe_50k.json", "piece_bpe_32k.model"


def plain(rows):
    a, b = align.side(ONE), align.side(TWO)
    counts, each = Counter(), []
    for doc_id, text in rows:
        groups, links, ids = [], [], ([], [])
        if text:
            ids = a(text).tolist(), b(text).tolist()
            if any(b"".join(t.bytes[i] for i in x) != (" " + text).encode() for t, x in zip((a, b), ids)):
                ids = [], []
            ends, p = {}, 0
            for n, i in enumerate(ids[0]):
                p += len(a.bytes[i])
                ends[p] = n
            p = since_a = since_b = 0
            for n, i in enumerate(ids[1]):
                p += len(b.bytes[i])
                if p in ends:
                    m = ends[p]
                    groups.append(",".join(map(str, ids[0][since_a : m + 1])) + "|" + ",".join(map(str, ids[1][since_b : n + 1])))
                    links.append((ids[0][m], i))
                    since_a, since_b = m + 1, n + 1
        counts.update(links)
        each.append((doc_id, len(ids[0]), len(ids[1]), links, ";".join(groups)))
    best = {}
    for (_, i), n in counts.items():
        best[i] = max(best.get(i, 0), n)
    return [
        (d, na, nb, len(x), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(g.encode()).hexdigest() if na else "")
        for d, na, nb, x, g in each
    ], counts


def by_key(rows):
    return sorted(rows, key=str)


@pytest.fixture
def texts(spark, docs):
    more = [(50, "a▁b"), (51, "<|endoftext|> <s> </s> é😀  x\r\n\n"), (52, "a" * 100_000), (53, " " * 3000), (53, " " * 3000), (54, "\u0001<0x0A>")]
    return docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))


@pytest.mark.parametrize("block, pairs, rows", [(4096, 65_536, 500_000), (7, 50, 0)])
def test_alignment(texts, block, pairs, rows):
    want, counts = plain(map(tuple, texts.collect()))
    got = align.align(texts, ONE, TWO, broadcast_rows=rows, block=block, pairs=pairs)
    assert by_key(map(tuple, got.collect())) == by_key(want)
    assert {(r["a"], r["b"]): r["count"] for r in align.pair_counts(texts, ONE, TWO).collect()} == counts


def test_alignment_query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_alignment(spark, str(tmp_path)).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    want, _ = plain((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    assert by_key(map(tuple, got.collect())) == by_key(want)


def test_alignment_empty(docs):
    assert align.align(docs.where("false")).count() == 0


def test_state_stays_small():
    one, two = align.side(ONE), align.side(TWO)
    text = "the quick brown fox " * 50_000
    a, b, state = one(text), two(text), align.Sweep(one, two)
    state.start(0, 0)
    blocks = [(int(x), s, t[k : k + 4096]) for s, t in ((align.A, a), (align.B, b)) for k in range(0, len(t), 4096) for x in [state.length[s][t[:k]].sum()]]
    held = 0
    for _, s, ids in sorted(blocks, key=lambda x: x[:2]):
        state.take(s, ids.astype("int64"))
        held = max(held, len(state.ids[align.A]) + len(state.ids[align.B]))
    assert held <= 3 * 4096 and not len(state.ids[align.A]) and not len(state.ids[align.B])


def test_tables_spell_what_the_lists_do():
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        s = align.side(name)
        ids = s("Ein naïver Text, 12 kWh ▁ \U0001f600.")
        assert align.gathered(s.table, ids) == b"".join(s.bytes[i] for i in ids.tolist()) and align.gathered(s.table, ids[:0]) == b""
