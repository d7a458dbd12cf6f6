"""Operator 11: exact marginals against enumeration, held-out pages, layouts by hand, ill-formed and empty pages."""

from __future__ import annotations

import itertools
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattloom.llm import dom, extract
from wattloom.llm.queries import op11_main_text

STORY = "Some words of the real story stand here, and they go on for a while."
REMARK = "I read this and I think the author is right about all of it, thanks."


def truth(page):
    tree = dom.parse(page)
    y = extract.labels_of(tree)
    return dom.joined(tree, {i for i in tree.text if y[i]})


@pytest.mark.parametrize("page", ["<div><p>a b c</p><nav>x</nav></div>", "<article><h1>t</h1><p>u <a href=x>v</a></p></article><footer>w</footer>", ""])
def test_marginals_by_enumeration(page):
    rng = np.random.default_rng(1)
    model = extract.Model(rng.normal(size=len(extract.NAMES)), *rng.normal(size=(2, 9)))
    forest = extract.Forest([dom.parse(page)])
    n = len(forest.parent)
    own = np.bincount(forest.node, model.weights[forest.feature], n)
    total, each = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        score = sum(own[i] for i in range(n) if y[i])
        for i in range(1, n):
            k, pair = forest.edge[i], (y[forest.parent[i]], y[i])
            score += {(0, 0): 0.0, (0, 1): -30.0, (1, 0): model.lone[k], (1, 1): model.both[k]}[pair]
        total += np.exp(score)
        each += np.exp(score) * np.array(y)
    assert np.allclose(forest.marginals(model), each / total, atol=1e-9)


def test_held_out_pages():
    pages = extract.written_pages(200, seed=11)
    want, got = [truth(p) for p in pages], extract.texts_of(pages, extract.written_model())
    both = sum(sum((Counter(a.split()) & Counter(b.split())).values()) for a, b in zip(want, got))
    assert both / sum(len(b.split()) for b in got) > 0.98 and both / sum(len(a.split()) for a in want) > 0.98
    assert sum(a == b for a, b in zip(want, got)) > 180


HAND = [
    (f"<header><h1>Site</h1><nav><a href=/>Home</a></nav></header><main><article><header><h1>Title here</h1></header><p>{STORY}</p><h3>Sub</h3><p>Sh is.</p><aside><p>{REMARK}</p></aside></article></main><section id='comments'><h2>Comments</h2><div class='comment'><p>{REMARK}</p></div></section><footer><p>{REMARK}</p></footer>",
     f"Title here {STORY} Sub Sh is."),
    (f"<div class='cookie-banner'><p>We use cookies. {REMARK}</p><button>OK</button></div><div id='header'>Big site</div><ul class='menu'><li><a href=1>one</a><li><a href=2>two</a></ul><div class='content'><h1>T</h1><p>{STORY}<div class='advert'>{REMARK}</div><p>{STORY}</div><div class='sidebar'><h3>More</h3><p>{REMARK}</p></div><div class='footer'>{REMARK}</div>",
     f"T {STORY} {STORY}"),
    (f"<article><p>{STORY}</p><script>if (a<b) '</p>'</script><style>p{{}}</style><p>a&amp;b &lt;c&gt; &nbsp; &#233; &am<!-- x --></p><div hidden>{REMARK}</div></article><form><label>Name</label><p>{REMARK}</p></form>", f"{STORY} a&b <c> é &am"),
    (f"<article><h1>A</h1><p><b>bold<br><p>{STORY}</article><ol class='commentlist'>" + f"<li class=comment><p>{REMARK} {REMARK}</p></li>" * 200 + "</ol><footer>&copy; x</footer>", f"A bold {STORY}"),
    ("plain text  only,\nwith no markup at all in it", "plain text only, with no markup at all in it"), ("<nav>menu</nav>", ""), ("<!-- never ends <p>x</p>", ""),
]


@pytest.mark.parametrize("page, text", HAND)
def test_layouts(page, text):
    assert extract.texts_of([page], extract.written_model()) == [text]


@pytest.mark.parametrize("page", ['<a x="' * 20_000, "<p><b>" * 20_000 + "t", "<!--" * 50_000, "</div>" * 50_000, "<ul><li>" * 10_000 + "t", "<" * 50_000, "<script>" * 50_000, "<a b='" * 30_000 + ">"])
def test_ill_formed_pages(page):
    began = time.time()
    extract.texts_of([page], extract.written_model())
    assert time.time() - began < 20


def test_labelled_pages(spark):
    pages = spark.createDataFrame([(p,) for p in extract.written_pages(150, seed=3)], "html string")
    own = extract.model_of(pages, sample=120)
    assert extract.texts_of([HAND[2][0]], own) == [HAND[2][1]]
    assert extract.model_of(pages.where("false")) is extract.written_model()


def test_query(spark, tmp_path):
    rows = [(i, f"http://x/{i}", p) for i, (p, _) in enumerate(HAND)] + [(90, None, None), (None, "u", ""), (91, "u", HAND[0][0]), (91, "u", HAND[0][0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("text", "n_chars", "tag", "lang")})
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = op11_main_text(spark, str(tmp_path))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = dict(enumerate(t for _, t in HAND)) | {90: "", None: "", 91: HAND[0][1]}
    assert sorted(map(tuple, got.collect()), key=str) == sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in rows), key=str)
    whole = extract.extract_text(pages)
    assert sorted(whole.columns) == sorted(pages.columns) and whole.where("false").count() == 0
