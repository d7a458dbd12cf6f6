"""Main text of web pages by a tree-structured graphical model over the DOM (operator 11).

Each element and each leaf of text is a binary variable: whether there is main text in it. A node's potential is linear in
what its tag, class, id, role, text and the elements around it say; parent and child share a potential by what kinds they
are, and main text can't stand in a node that has none. Sum-product messages upward and downward give exact marginals of
all nodes, a level of all trees of a batch at a time; leaves whose marginal reaches one half are the text.

The weights maximise the likelihood of labelled pages, whose gradient is what the labels count less what the marginals
expect. Labelled pages are HTML in which `data-main="1"` marks elements of main text (and "0" what in them is not): those
that the caller gives, at most `sample` of them, or else pages of many layouts that are written here from random words.
Scoring is one map over the pages; nothing is shuffled and a page is held once.

Nulls: a null or empty page has an empty text, as have pages without main text. Null ids and urls are kept, repeated rows
are extracted once each, an empty table gives no rows. Other columns pass through, unless they bear a new one's name.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import shielded, slices
from .dom import HINTS, MARK, Tree, joined, parse

#: Labelled pages that a fit reads at most, and steps of its ascent.
SAMPLE, STEPS = 600, 300
#: A leaf whose marginal reaches this is main text.
AT = 0.5
_NEVER = -30.0
_TEXTUAL = set("p h1 h2 h3 h4 h5 h6 li pre td th dd dt figcaption caption summary legend address".split())
_TAGS = ["", *sorted(_TEXTUAL | set("article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol search section table tr ul".split())), "other"]
_WORDS, _LINKED, _KINDS = (1, 3, 10, 30), (0.0, 0.3, 0.7), 9


def _names() -> list[str]:
    out = ["bias", *(f"tag={t}" for t in _TAGS), *(f"own={h}" for h in HINTS), *(f"around={h}" for h in HINTS), "own=mixed", "own=none", "around=none"]
    for kind in ("leaf", "element"):
        out += [f"{kind} words {i}" for i in range(len(_WORDS) + 1)] + [f"{kind} linked {i}" for i in range(len(_LINKED) + 1)]
    return out + ["head in main", "leaf ends a sentence", "leaf has a copyright sign", "leaf of a heading"]


NAMES = _names()
_AT = {n: i for i, n in enumerate(NAMES)}


class Forest:
    """Trees of a batch as one set of arrays: features of nodes, kinds of edges, nodes by level."""

    def __init__(self, trees: list[Tree]):
        self.first = np.cumsum([0, *(len(t.tag) for t in trees)])
        self.parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + at) for t, at in zip(trees, self.first)])
        n = len(self.parent)
        node: list[int] = []
        feature: list[int] = []
        words, linked = np.zeros(n), np.zeros(n)
        kind = np.zeros(n, np.int64)
        for t, at in zip(trees, self.first.tolist()):
            for i, tag in enumerate(t.tag):
                hints, around = t.own[i], t.around[i]
                has = [0, _AT.get(f"tag={tag}", _AT["tag=other"])]
                has += [_AT[f"own={h}"] for h in hints] if len(hints) < 2 or "main" not in hints else [_AT["own=mixed"]]
                has += [_AT[f"around={h}"] for h in around]
                has += [_AT["head in main"]] if "head" in hints and "main" in around else []
                has += [] if hints else [_AT["own=none"]]
                has += [] if around else [_AT["around=none"]]
                if not tag:
                    text = "".join(t.text[i])
                    words[at + i], linked[at + i] = len(text.split()), t.linked[i] / len(text)
                    end = text.rstrip()[-1:]
                    has += [_AT["leaf ends a sentence"]] if end and end in ".!?…。" else []
                    has += [_AT["leaf has a copyright sign"]] if "©" in text else []
                    has += [_AT["leaf of a heading"]] if t.tag[t.parent[i]] in ("h1", "h2", "h3") else []
                else:
                    kind[at + i] = 1 if tag in _TEXTUAL else 2
                node += [at + i] * len(has)
                feature += has
        depth = np.zeros(n, np.int64)
        for i, p in enumerate(self.parent.tolist()):  # parents come first
            if p >= 0:
                depth[i] = depth[p] + 1
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
        leaf = kind == 0
        total, link = words.copy(), words * linked
        for level in self.levels[:0:-1]:
            np.add.at(total, self.parent[level], total[level])
            np.add.at(link, self.parent[level], link[level])
        share = link / np.maximum(total, 1)
        names = np.where(leaf, _AT["leaf words 0"], _AT["element words 0"]), np.where(leaf, _AT["leaf linked 0"], _AT["element linked 0"])
        self.node = np.concatenate([node, np.arange(n), np.arange(n)]).astype(np.int64)
        self.feature = np.concatenate([feature, names[0] + np.searchsorted(_WORDS, total, "right"), names[1] + np.searchsorted(_LINKED, share, "left")]).astype(np.int64)
        # edges: what the parent is (an article, another container, a textual element) by what the child is
        above = np.concatenate([[0 if (g in ("article", "main") or "main" in o) else 2 if g in _TEXTUAL else 1 for g, o in zip(t.tag, t.own)] for t in trees]) if trees else np.zeros(0, np.int64)
        self.edge = np.where(self.parent >= 0, above[self.parent] * 3 + kind, 0).astype(np.int64)

    def marginals(self, model: "Model") -> np.ndarray:
        """P(there is main text in it) for each node: sum-product, upward and downward."""
        n = len(self.parent)
        below = np.zeros((n, 2))  # own potential and messages of the children, as logarithms
        below[:, 1] = np.bincount(self.node, model.weights[self.feature], n)
        sent = np.zeros((n, 2))
        both, lone = model.both[self.edge], model.lone[self.edge]
        for level in self.levels[:0:-1]:
            b0, b1 = below[level, 0], below[level, 1]
            sent[level, 0] = np.logaddexp(b0, b1 + _NEVER)
            sent[level, 1] = np.logaddexp(b0 + lone[level], b1 + both[level])
            np.add.at(below, self.parent[level], sent[level])
        down = np.zeros((n, 2))
        for level in self.levels[1:]:
            up = self.parent[level]
            rest = below[up] + down[up] - sent[level]
            down[level, 0] = np.logaddexp(rest[:, 0], rest[:, 1] + lone[level])
            down[level, 1] = np.logaddexp(rest[:, 0] + _NEVER, rest[:, 1] + both[level])
        belief = below + down
        return np.exp(belief[:, 1] - np.logaddexp(belief[:, 0], belief[:, 1]))


class Model:
    """Weights of node features; of each kind of edge, potentials of main text in both and in the parent alone."""

    def __init__(self, weights: np.ndarray, both: np.ndarray, lone: np.ndarray):
        self.weights, self.both, self.lone = weights, both, lone


def labels_of(tree: Tree) -> np.ndarray:
    """1 for leaves whose nearest mark says so, and for elements with such a leaf in them."""
    n = len(tree.tag)
    mark, y = [None] * n, np.zeros(n)
    for i in range(n):
        p = tree.parent[i]
        mark[i] = tree.mark[i] if tree.mark[i] is not None else mark[p] if p >= 0 else None
        y[i] = not tree.tag[i] and mark[i] == "1" and not "".join(tree.text[i]).isspace()
    for i in range(n - 1, 0, -1):
        y[tree.parent[i]] = max(y[tree.parent[i]], y[i])
    return y


def fit(pages: Iterable[str], steps: int = STEPS, decay: float = 1e-4, rate: float = 0.1) -> Model:
    """Maximum likelihood by gradient ascent (Adam) over labelled pages."""
    trees = [parse(p) for p in pages]
    forest, y = Forest(trees), np.concatenate([labels_of(t) for t in trees])
    sizes = (len(NAMES), _KINDS, _KINDS)
    theta, n = np.zeros(sum(sizes)), len(trees)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    inner = forest.parent >= 0
    for step in range(1, steps + 1):
        model = Model(*np.split(theta, np.cumsum(sizes)[:-1]))
        gap = y - forest.marginals(model)
        above = gap[forest.parent[inner]] - gap[inner]
        gradient = np.concatenate([
            np.bincount(forest.feature, gap[forest.node], sizes[0]), np.bincount(forest.edge[inner], gap[inner], _KINDS), np.bincount(forest.edge[inner], above, _KINDS),
        ]) / n - decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta = theta + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(*np.split(theta, np.cumsum(sizes)[:-1]))


def written_pages(n: int = 600, seed: int = 0) -> list[str]:
    """Labelled pages of many layouts from random words; what says what a block is for varies, as does where it stands."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b ch d f g l m n p r s t th v".split() for b in "a e i o u an er in on ea".split()]
    word = lambda: "".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 2, 3))))
    one = rng.choice
    attr = lambda *names: f' {one(("class", "id"))}="{one(names)}"'

    def text(low: int, high: int) -> str:
        out = [word() for _ in range(rng.randint(low, high))]
        for k in range(0, len(out), rng.randint(6, 15)):
            out[k] = out[k].capitalize()
            if k and rng.random() < 0.8:
                out[k - 1] += "."
        if rng.random() < 0.1:
            out = [w + one(("%%%", "&amp;&amp;", "***", "!!", "|", "123")) for w in out]
        return " ".join(out) + one((".", ".", ".", "", "!", "?"))

    def rich(t: str) -> str:
        words = t.split()
        for _ in range(one((0, 0, 0, 1, 2))):
            k = rng.randrange(len(words))
            words[k] = one(("<b>%s</b>", '<a href="/x">%s</a>', "<i>%s</i>", "<em>%s</em>", "%s<br>", '<span class="x">%s</span>')) % words[k]
        return " ".join(words)

    def links(low: int, high: int) -> str:
        items = [f'<a href="/{word()}">{text(1, 4)}</a>' for _ in range(rng.randint(low, high))]
        return one(("<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", " | ".join(items), "".join(f"<div>{x}</div>" for x in items)))

    def paragraphs(low: int, high: int) -> str:
        out = []
        for _ in range(rng.randint(low, high)):
            kind, t = rng.random(), rich(text(*one(((1, 4), (8, 40), (30, 120)))))
            if kind < 0.75:
                out.append(f"<p>{t}</p>" if rng.random() < 0.7 else f"<p><b>{t}<br>" if rng.random() < 0.2 else f"<p>{t}")
            elif kind < 0.8:
                level = one("2234")
                out.append(f"<h{level}>{text(1, 8)}</h{level}>")
            elif kind < 0.85:
                out.append("<ul>" + "".join(f"<li>{rich(text(2, 20))}</li>" for _ in range(rng.randint(1, 6))) + "</ul>")
            elif kind < 0.88:
                out.append(f"<blockquote><p>{t}</p></blockquote>")
            elif kind < 0.91:
                out.append("<table>" + "".join(f"<tr><td>{text(1, 5)}</td><td>{text(1, 5)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            elif kind < 0.94:
                out.append(f"<figure><img src=x><figcaption>{text(3, 15)}</figcaption></figure>")
            elif kind < 0.96:
                out.append(f"<pre>{t}</pre>")
            elif kind < 0.98:
                out.append(f"<section><h3>{text(1, 6)}</h3><p>{t}</p></section>" if rng.random() < 0.6 else f"<dl><dt>{text(1, 3)}</dt><dd>{t}</dd></dl>")
            else:
                out.append(f"<div>{t}</div>")
        return "".join(out)

    def boxed(tag: str, inner: str, *names: str) -> str:
        return f"<{tag}{attr(*names) if names else ''}>{inner}</{tag}>"

    def comments() -> str:
        each = lambda: boxed(one(("div", "li", "article")), one(("", f"<b>{word()}</b>", boxed("span", word(), "author"))) + paragraphs(1, 3), one(("comment", "reply", "response", "x")), "comment")
        body = one(("", f"<h2>{text(1, 3)}</h2>", f"<h3>{text(1, 3)}</h3>")) + "".join(each() for _ in range(one((1, 3, 6, 20))))
        return boxed(one(("section", "div", "ol", "aside")), body, "comments", "commentlist", "disqus_thread", "discussion", "responses", "user-comments", "comments-area")

    def ad() -> str:
        return one((
            lambda: boxed("div", rich(text(1, 30)), "ad", "ads", "advert", "ad-slot", "sponsored", "promo", "banner-ad", "advertisement"),
            lambda: boxed("aside", f"<p>{text(4, 30)}</p>", "ad", "sponsor", "promotion"), lambda: f'<ins class="adsbygoogle">{text(1, 8)}</ins>',
            lambda: boxed("section", f"<h3>{text(1, 5)}</h3><p>{text(4, 40)}</p>", "sponsored", "advertisement"), lambda: boxed("p", text(2, 20), "ad", "sponsored"),
        ))()

    def notice() -> str:
        body = one((lambda: f"<p>{text(6, 50)}</p><button>{word()}</button>", lambda: text(5, 30), lambda: f"<span>{text(3, 20)}</span> <a href='#'>{word()}</a>"))()
        return one((
            lambda: boxed("div", body, "cookie-notice", "cookies", "consent", "gdpr-banner", "notice", "alert", "newsletter-signup", "popup", "modal", "paywall"),
            lambda: f'<div role="{one(("dialog", "alert"))}">{body}</div>', lambda: f"<dialog open>{body}</dialog>", lambda: boxed("section", body, "newsletter", "subscribe", "notification"),
            lambda: boxed("aside", body, "notice", "alert", "cookie-consent"), lambda: boxed("p", text(5, 30), "notice", "cookie-warning"),
        ))()

    def form() -> str:
        body = f"<p>{text(3, 25)}</p>" * rng.randint(0, 2) + f"<label>{text(1, 4)}</label><input><textarea>{text(0, 9)}</textarea><select><option>{word()}</select><button>{word()}</button>"
        return f"<form{attr('search', 'login', 'contact', 'x')}>{body}</form>"

    def side() -> str:
        body = "".join(one((f"<h3>{text(1, 4)}</h3>", "")) + one((lambda: links(2, 9), lambda: f"<p>{text(3, 60)}</p>", lambda: ad()))() for _ in range(rng.randint(1, 4)))
        return one((
            lambda: boxed("aside", body), lambda: boxed("div", body, "sidebar", "side", "widget-area", "related", "right-rail", "recommended", "popular-posts", "secondary sidebar"),
            lambda: boxed("aside", body, "sidebar", "related", "x"), lambda: boxed("section", body, "related", "trending", "widget", "more-stories recommended"), lambda: f'<div role="complementary">{body}</div>',
        ))()

    def nav() -> str:
        return one((
            lambda: boxed("nav", links(2, 9)), lambda: boxed("nav", links(2, 9), "menu", "x"), lambda: boxed("div", links(2, 12), "menu", "nav", "navbar", "breadcrumbs", "topbar", "main-navigation", "pagination"),
            lambda: f'<div role="navigation">{links(2, 6)}</div>', lambda: f'<ul{attr("nav", "menu", "breadcrumb")}><li><a href="/">{word()}</a></li><li><a href="/a">{word()}</a></li></ul>', lambda: boxed("div", links(5, 15)),
        ))()

    def head() -> str:
        body = one((f"<h1>{text(1, 3)}</h1>", f"<h1>{text(1, 6)}</h1>", f"<p>{text(1, 12)}</p>", f'<a href="/">{word()}</a>', f"<div>{text(1, 8)}</div>")) + one(("", nav(), form(), f"<p>{text(2, 20)}</p>"))
        return one((lambda: boxed("header", body), lambda: boxed("header", body, "site-header", "x"), lambda: boxed("div", body, "header", "masthead", "banner", "site-branding", "logo"), lambda: f'<div role="banner">{body}</div>'))()

    def foot() -> str:
        body = "".join(one((lambda: f"&copy; {text(1, 12)}", lambda: links(2, 8), lambda: f"<p>{text(4, 60)}</p>", lambda: text(3, 30)))() for _ in range(rng.randint(1, 3)))
        return one((lambda: boxed("footer", body), lambda: boxed("footer", body, "site-footer", "x"), lambda: boxed("div", body, "footer", "bottom", "copyright", "site-footer", "colophon"), lambda: f'<div role="contentinfo">{body}</div>'))()

    share = lambda: boxed(one(("div", "ul")), links(2, 5), "share", "social", "sharing", "share-buttons", "follow-us")
    pages = []
    for _ in range(n):
        inside = "".join(f'<div {MARK}="0">{one((ad, notice, side, share, form, nav))()}</div>' if rng.random() < 0.2 else paragraphs(1, 5) for _ in range(rng.randint(1, 5)))
        title = f"<h1>{text(1, 12)}</h1>"
        main = one(("", title, title, title, f'<div class="title">{title}</div>')) + (inside if "<p" in inside else paragraphs(1, 6) + inside)
        inner = ("" if rng.random() < 0.7 else f'<div {MARK}="0">{one((foot, comments, share))()}</div>')
        headed = main.replace(title, f"<header>{title}</header>") if rng.random() < 0.3 else main
        core = one((
            lambda: f'<article {MARK}="1">{headed}{inner}</article>', lambda: f'<article {MARK}="1"{attr("post", "x", "story")}>{main}{inner}</article>', lambda: f'<main><article {MARK}="1">{headed}{inner}</article></main>',
            lambda: f'<main {MARK}="1">{main}{inner}</main>', lambda: f'<div {MARK}="1"{attr("content", "post", "article-body", "entry-content", "story", "main", "post-text")}>{main}{inner}</div>',
            lambda: f'<div role="main" {MARK}="1">{main}</div>', lambda: f'<section {MARK}="1"{attr("content", "article", "x")}>{main}{inner}</section>', lambda: f'<div><div {MARK}="1">{main}</div></div>',
            lambda: f'<table><tr><td>{links(3, 9)}</td><td {MARK}="1">{main}</td></tr></table>', lambda: f'<div class="wrapper content-with-sidebar"><div {MARK}="1" class="content">{main}</div>{side()}</div>', lambda: f'<div {MARK}="1">{main}</div>',
            lambda: f'<form id="page"><div {MARK}="1" class="content">{main}</div></form>', lambda: "",
        ))() if rng.random() < 0.97 else f'<div {MARK}="1">{rich(text(5, 80))}</div>'
        before = "".join(part() for part in (notice, head, nav, ad, form, share, side) if rng.random() < 0.35)
        after = "".join(part() for part in (share, comments, side, ad, form, notice, nav, foot) if rng.random() < 0.4)
        whole = one(("%s", "%s", "<div>%s</div>", '<div id="page">%s</div>', '<div class="container has-sidebar">%s</div>')) % (before + core + after)
        pages.append(f"<!DOCTYPE html><html><head><title>{text(1, 6)}</title></head><body{one(('', attr('page', 'has-sidebar', 'post')))}>{whole}{one(('</body></html>', ''))}")
    return pages


_MODELS: dict[tuple[int, int], Model] = {}


def written_model(n: int = 600, seed: int = 0) -> Model:
    if (n, seed) not in _MODELS:
        _MODELS[n, seed] = fit(written_pages(n, seed))
    return _MODELS[n, seed]


def model_of(labelled: DataFrame | None = None, column: str = "html", sample: int = SAMPLE) -> Model:
    """The model of at most `sample` labelled pages, those of the least hashes; without any, that of the written pages."""
    if labelled is None:
        return written_model()
    chosen = labelled.select(F.col(column).alias("html")).where(f"html like '%{MARK}%'").orderBy(F.xxhash64("html"), "html").limit(sample)
    pages = [r["html"] for r in chosen.collect()]
    return fit(pages) if pages else written_model()


def texts_of(pages: list[str | None], model: Model, at: float = AT) -> list[str]:
    """Main texts of a batch of pages."""
    trees = [parse(p or "") for p in pages]
    forest = Forest(trees)
    p = forest.marginals(model)
    return [joined(t, {i for i in t.text if p[first + i] >= at}) for t, first in zip(trees, forest.first.tolist())]


def extract_text(pages: DataFrame, model: Model | None = None, at: float = AT) -> DataFrame:
    """pages(html, ...) with `text` and `n_chars`, its code points."""
    inner, restore = shielded(pages, "html")
    model = model or written_model()
    schema = T.StructType([*inner.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            texts = texts_of(b.column("html").to_pylist(), model, at)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names
            )

    return restore(inner.mapInArrow(run, schema), "text", "n_chars")
