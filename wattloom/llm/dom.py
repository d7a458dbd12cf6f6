"""DOM trees of raw pages as arrays, for operator 11: elements, and leaves that hold the text of blocks.

A lenient parser in one pass, linear in the page: paragraphs, list items and cells close where the next one opens, end tags
without a start are dropped, and what a page leaves open ends with it. Inline elements belong to the block around them
unless an attribute says what they are for. Text of scripts, styles and other elements that show none never enters a tree.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

# Fixed values of the HTML standard.
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul".split()
)
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = set("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
#: Elements whose text is never shown as text of the page.
DEAD = set("audio button canvas datalist head object option select svg template video".split())
BOUNDARY = set("button caption object table td template th".split())

#: What words of class, id and role say an element is for; fixed values, by purpose.
HINTS = {
    "main": "article body blog content copy entry hentry main markdown post prose story text",
    "nav": "breadcrumb breadcrumbs menu nav navbar navigation pager pagination tabs toc topbar",
    "head": "banner branding header logo masthead",
    "foot": "bottom colophon contentinfo copyright foot footer legal",
    "side": "aside complementary more popular rail recommended related side sidebar trending widget widgets",
    "ad": "ad ads adsbygoogle advert advertisement advertising adverts promo promotion sponsor sponsored",
    "notice": "alert consent cookie cookies dialog disclaimer gdpr message modal newsletter notice notification overlay paywall popup signup subscribe toast warning",
    "comment": "comment commentlist comments discussion disqus feedback replies reply respond responses",
    "share": "follow like share sharing social toolbar",
    "form": "form login search",
}
_HINT_OF = {word: kind for kind, words in HINTS.items() for word in words.split()}
#: Tags that say the same as a hint.
_TAG_HINT = {
    "article": "main", "main": "main", "nav": "nav", "menu": "nav", "header": "head", "footer": "foot", "aside": "side",
    "dialog": "notice", "form": "form", "search": "form",
}

_ATTRS = r"(?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>=]++|=)*+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*)({_ATTRS})>")
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: The attribute by which labelled pages mark what is main text (1) and what inside of it is not (0).
MARK = "data-main"


def _purpose(raw: str) -> tuple[frozenset[str], bool, str | None]:
    """(hints, hidden, mark) of an attribute string."""
    hints, hidden, mark = set(), False, None
    if raw:
        for name, *values in _ATTR.findall(raw):
            name, value = name.lower(), next((v for v in values if v), "")
            if name in ("class", "id", "role"):
                hints.update(k for w in _WORDS.findall(value) if (k := _HINT_OF.get(w.lower())))
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value.lower())):
                hidden = True
            elif name == MARK:
                mark = value
    return frozenset(hints), hidden, mark


class Tree:
    """Nodes in page order; of node i: tag[i] ("" for a leaf), parent[i] (-1 for the root), own[i] hints, around[i] hints of
    the elements around it, mark[i]. Leaves have text[i], linked[i] (characters within links) and block[i]."""

    def __init__(self) -> None:
        self.tag, self.parent, self.own, self.around, self.mark = ["html"], [-1], [frozenset()], [frozenset()], [None]
        self.text: dict[int, list[str]] = {}
        self.linked: dict[int, int] = {}
        self.block: dict[int, int] = {}

    def add(self, tag: str, parent: int, own: frozenset[str], mark: str | None) -> int:
        around = self.around[parent] | self.own[parent]
        if self.tag[parent] in ("article", "main") and "comment" not in around:
            around = frozenset({"main"})  # what is around an article says nothing about what is in it
        for column, value in zip((self.tag, self.parent, self.own, self.around, self.mark), (tag, parent, own, around, mark)):
            column.append(value)
        return len(self.tag) - 1


_CACHE: dict[tuple[str, str], tuple] = {}


def parse(page: str) -> Tree:
    tree = Tree()
    # of each open element: name, node it is or belongs to, whether its text is lost, links around
    names, nodes, lost, links = ["html"], [0], [False], [0]
    where: dict[str, list[int]] = defaultdict(list)  # open elements by name
    chains: dict[str, list[int]] = {"p": [], "li": [], "dd": [], "td": [], "block": [], "bound": []}
    families = {"li": ("li", "ul", "ol", "menu", "dir"), "dd": ("dd", "dt", "dl"), "td": ("td", "th", "tr", "table")}
    member = {name: family for family, all_of in families.items() for name in all_of}
    blocks, leaf, size = 0, -1, len(page)

    def close(upto: int) -> None:
        """Closes open elements from place upto on."""
        for name in names[upto:]:
            where[name].pop()
        del names[upto:], nodes[upto:], lost[upto:], links[upto:]
        for chain in chains.values():
            while chain and chain[-1] >= upto:
                chain.pop()

    def write(text: str) -> None:
        nonlocal leaf
        if lost[-1] or not text:
            return
        node = nodes[-1]
        if leaf < 0 or tree.parent[leaf] != node:
            if leaf < 0 and text.isspace():
                return
            leaf = tree.add("", node, frozenset(), None)
            tree.text[leaf], tree.linked[leaf], tree.block[leaf] = [], 0, blocks
        tree.text[leaf].append(text)
        if links[-1]:
            tree.linked[leaf] += len(text)

    at = 0
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            write(html.unescape(page[at:]))
            break
        if lt > at:
            write(html.unescape(page[at:lt]))
        after = page[lt + 1 : lt + 2]
        if after == "!" or after == "?" or (after == "/" and not page[lt + 2 : lt + 3].isalpha()):
            comment = page.startswith("<!--", lt)
            end = page.find("-->", lt + 2) if comment else page.find(">", lt + 1)
            at = size if end < 0 else end + (3 if comment else 1)
            continue
        if not (after == "/" or (after.isascii() and after.isalpha())):
            write("<")
            at = lt + 1
            continue
        found = _TAG.match(page, lt)
        if not found:
            break  # a tag that the page leaves open
        at = found.end()
        ending, name, raw = found.groups()
        name = name.lower()
        if ending:
            if name == "br":
                write(" ")
                continue
            if not where[name]:
                continue
            place = where[name][-1]
            bound, inner = chains["bound"], chains["block"]
            if name in BLOCK:
                if not (bound and bound[-1] > place and name not in ("table", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "body", "html")):
                    close(place)
                    blocks, leaf = blocks + 1, -1
            elif not (inner and inner[-1] > place) or name in DEAD:
                close(place)
            continue
        if name == "br":
            write(" ")
            continue
        if name == "hr":
            blocks, leaf = blocks + 1, -1
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, at) if name != "plaintext" else None
            at = end.end() if end else size
            continue
        key = (name, raw)
        if key not in _CACHE:
            if len(_CACHE) > 20_000:
                _CACHE.clear()
            _CACHE[key] = _purpose(raw)
        hints, hidden, mark = _CACHE[key]
        if name in _TAG_HINT:
            hints = hints | {_TAG_HINT[name]}
        if where["head"] and name != "template":
            close(where["head"][0])  # nothing that is shown stands in a head
        if name in BLOCK:
            if name in ("html", "body") and where[name]:
                continue
            if chains["p"] and names[chains["p"][-1]] == "p":
                close(chains["p"][-1])
            family = member.get(name)
            if family and name in ("li", "dd", "dt", "td", "th", "tr"):
                closes = {"li": ("li",), "dd": ("dd", "dt"), "td": ("td", "th") if name != "tr" else ("td", "th", "tr")}[family]
                while chains[family] and names[chains[family][-1]] in closes:
                    close(chains[family][-1])
            blocks, leaf = blocks + 1, -1
        if name in ("html", "body"):
            hints = frozenset()  # they are around everything
        place = len(names)
        own_node = name in BLOCK or bool(hints) or mark is not None
        node = tree.add(name, nodes[-1], hints, mark) if own_node and not lost[-1] else nodes[-1]
        names.append(name)
        nodes.append(node)
        lost.append(lost[-1] or hidden or name in DEAD)
        links.append(links[-1] + (name == "a"))
        where[name].append(place)
        if name in BLOCK:
            chains["block"].append(place)
        if name in BOUNDARY:
            chains["bound"].append(place)
        if name == "p" or name in BOUNDARY:
            chains["p"].append(place)
        if name in member:
            chains[member[name]].append(place)
    return tree


def joined(tree: Tree, keep) -> str:
    """The text of the leaves in keep: white space within a block is one blank, and so is what parts blocks."""
    out: dict[int, list[str]] = {}
    for leaf, parts in tree.text.items():
        if leaf in keep:
            out.setdefault(tree.block[leaf], []).extend(parts)
    return " ".join(t for parts in out.values() if (t := " ".join("".join(parts).split())))
