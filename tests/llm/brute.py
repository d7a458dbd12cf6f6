"""Plain Python versions of the operators' contracts."""

from __future__ import annotations

import hashlib
import re

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def words(text):
    return WORD.findall((text or "").translate(AZ))


def secrets(text):
    text = text or ""
    spans = [[(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8 and m[1].isascii()]]
    spans.append([(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16])
    spans.append([(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])
    flat = sorted(sum(spans, []))
    return tuple(map(len, spans)) + (sha(",".join(f"{k}:{s}:{e}" for s, _, k, e in flat)),)


PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def licenses(text):
    ws, at, labels = words(text), [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def leaks(docs, items, width=10):
    """docs: texts; items: (item_id, text)."""
    windows = {}
    for item, text in items:
        ws = words(text)
        if ws:
            w = min(width, len(ws))
            for i in range(len(ws) - w + 1):
                windows.setdefault(tuple(ws[i : i + w]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for text in docs:
        ws, hit, ids = words(text), set(), set()
        for n in sizes:
            for i in range(len(ws) - n + 1):
                if (own := windows.get(tuple(ws[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    ids |= own
        out.append((len(ws), len(hit), len(ids), sha(",".join(sorted(ids))), bool(hit)))
    return out


RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def url(u):
    host = path = ""
    if u is not None and "://" in u:
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(AZ)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path) + ((best[1], best[2]) if best else (None, None))


SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    ws = SPLIT.findall((text or "").translate(AZ))
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else ({tuple(ws)} if ws else set())


def components(docs):
    """[(doc_id, text)] -> {row: (n_shingles, component)} by row number, comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    seen = set()
    for i, s in enumerate(sets):
        for j in {j for x in s for j in where[x] if j < i}:
            if (i, j) not in seen:
                seen.add((i, j))
                both = len(s & sets[j])
                if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return [(len(s), least[root(i)]) for i, s in enumerate(sets)]
