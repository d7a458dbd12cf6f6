"""Secret scan over a trigram inverted index (operator 2), in DataFrame expressions only.

1. Each rule's regex is parsed (on the driver, rule text only) into a Boolean query over lower-cased trigrams that every
   match must hold: an OR of ANDs. A rule without mandatory trigrams gets no query.
2. ``postings`` lists (trigram, doc_id) for the trigrams that some rule asks for; other trigrams are never looked up.
3. ``candidates`` intersects the postings of each document and keeps the rules whose query holds.
4. ``find_secrets`` verifies: an indexed rule's regex runs on its candidates only, a rule without a query on all texts.
   Spans are exact code-point intervals of the leftmost non-overlapping matches.

Texts do not move if the candidates, counted first, are few enough to broadcast; beyond that both sides are shuffled
by doc_id.

Nulls: a null text is empty. A null doc_id is a key like any other. Rows that share a doc_id share candidates, which
verification on each row's own text makes harmless. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded, sized, stored

try:
    import re._constants as _c
    import re._parser as _p
except ImportError:  # Python < 3.11
    import sre_constants as _c
    import sre_parse as _p


@dataclass(frozen=True)
class Rule:
    kind: str
    regex: str  # valid in Java and Python alike
    group: int = 0  # whose length counts
    least: int = 0  # shorter matches are dropped, but have used up their text
    ignore_case: bool = False


#: Fixed by the query's contract. hex and access name the least length in the regex: a maximal run is the same match.
BASE_RULES = (
    Rule("assign", "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
         "|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 1, 8),
    Rule("access", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
#: Published token formats that the method adds.
MORE_RULES = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", "[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]{6,}\\.eyJ[A-Za-z0-9_-]{6,}\\.[A-Za-z0-9_-]{6,}"),
    Rule("url_login", "://[A-Za-z0-9._-]+:[A-Za-z0-9._%+-]+@"),
)
RULES = BASE_RULES + MORE_RULES
#: Character classes with more lower-cased members than this count as "any character", sets of strings beyond as unknown.
MAX_CLASS, MAX_STRINGS = 6, 64


def _pieces(node) -> list[set[str] | None]:
    """A regex sequence as a list of exact string sets (lower-cased) and None for what is unknown."""
    out: list[set[str] | None] = []
    for op, arg in node:
        if op is _c.LITERAL:
            out.append({chr(arg).lower()})
        elif op is _c.IN:
            chars: set[str] | None = set()
            for kind, x in arg:
                span = [x] if kind is _c.LITERAL else range(x[0], x[1] + 1) if kind is _c.RANGE else None
                chars = None if span is None or chars is None or len(span) > 300 else chars | {chr(v).lower() for v in span}
            out.append(chars if chars and len(chars) <= MAX_CLASS else None)
        elif op is _c.SUBPATTERN:
            out.extend(_pieces(arg[3]))
        elif op is _c.BRANCH:
            whole = [_strings(_pieces(x)) for x in arg[1]]
            out.append(set().union(*whole) if all(whole) else None)
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT):
            low, high, body = arg
            inner = _strings(_pieces(body))
            if inner and (low, high) == (0, 1):
                out.append(inner | {""})
            elif inner and low == high and low <= 8:
                out.extend([inner] * low)
            elif low:
                out.extend([*([inner] * min(low, 8)), None])
            else:
                out.append(None)
        else:
            out.append(None)
    return out


def _strings(pieces: list[set[str] | None]) -> set[str] | None:
    """All strings of a sequence, or None if they are unknown or too many."""
    total = {""}
    for x in pieces:
        if x is None or len(total) * len(x) > MAX_STRINGS:
            return None
        total = {a + b for a in total for b in x}
    return total


def trigram_query(regex: str) -> list[frozenset[str]] | None:
    """Sets of trigrams, one of which every match (lower-cased) holds entirely; None without mandatory trigrams."""
    runs: list[list[set[str]]] = [[]]
    for piece in _pieces(_p.parse(regex)):
        trial = None if piece is None else _strings([*runs[-1], piece])
        if piece is None:
            runs.append([])
        elif trial is None:
            runs.append([piece])
        else:
            runs[-1].append(piece)
    options: list[list[frozenset[str]]] = []
    for run in runs:
        texts = _strings(run) or {""}
        if min(map(len, texts)) >= 3:
            options.append([frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(texts)])
    if not options:
        return None
    best = min(options, key=lambda o: (len(o) > 8, -min(map(len, o)), len(o)))  # long strings, few alternatives
    every = [frozenset().union(*x) for x in itertools.product(*(o for o in options if o is best or len(o) == 1))]
    return sorted({x for x in every if not any(y < x for y in every)}, key=sorted)


def vocabulary(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for q in trigram_query(r.regex) or [] for t in q})


def postings(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(trigram, doc_id) for each of the rules' trigrams that the lower-cased text holds."""
    low = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in vocabulary(rules)]))
    return low.select("doc_id", F.explode(held).alias("trigram")).select("trigram", "doc_id")


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, kinds): the rules whose trigram query the document's postings meet."""
    place = {t: i for i, t in enumerate(vocabulary(rules))}
    sets = {r.kind: trigram_query(r.regex) for r in rules}
    lookup = F.create_map(*itertools.chain(*((F.lit(t), F.lit(i)) for t, i in place.items()))) if place else None
    if lookup is None:
        return index.select("doc_id", F.array().cast("array<string>").alias("kinds")).limit(0)
    at, n = F.element_at(lookup, F.col("trigram")), (len(place) + 61) // 62
    masks = index.select("doc_id", at.alias("_at")).groupBy("doc_id").agg(
        *[F.bit_or(F.when(F.floor(F.col("_at") / 62) == w, F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("_at") % 62).cast("int"))).otherwise(F.lit(0).cast("long"))).alias(f"_m{w}") for w in range(n)]
    )

    def holds(trigrams: frozenset[str]) -> Column:
        bits = [sum(1 << (place[t] % 62) for t in trigrams if place[t] // 62 == w) for w in range(n)]
        tests = [F.col(f"_m{w}").bitwiseAND(F.lit(b)) == F.lit(b) for w, b in enumerate(bits) if b]
        out = tests[0]
        for x in tests[1:]:
            out = out & x
        return out

    kinds = []
    for kind, query in sets.items():
        if query:
            test = holds(query[0])
            for q in query[1:]:
                test = test | holds(q)
            kinds.append(F.when(test, F.lit(kind)))
    return masks.select("doc_id", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, end, rank, kind>> of the rule's matches, in code points."""
    regex = F.lit(rule.regex)
    value = F.regexp_extract_all(text, regex, F.lit(rule.group)) if rule.group else F.regexp_extract_all(text, regex, F.lit(0))
    parts = F.arrays_zip(
        F.split(text, rule.regex, -1).alias("gap"), F.regexp_extract_all(text, regex, F.lit(0)).alias("all"), value.alias("val")
    )
    kind = "array<struct<start:bigint,end:bigint,rank:int,kind:string>>"
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["all"]), F.lit(0))
        one = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(order).alias("rank"), F.lit(rule.kind).alias("kind")))
        new = F.when(F.char_length(x["val"]) >= max(1, rule.least), F.concat(acc["found"], one)).otherwise(acc["found"])
        return F.struct(end.cast("long").alias("at"), new.alias("found"))

    found = F.aggregate(parts, start, step)["found"]
    return F.when(F.regexp_like(text, regex), found).otherwise(F.array().cast(kind))


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_rows: int = 500_000
) -> DataFrame:
    """docs with the column secrets: array<struct<start, end, rank, kind>> sorted by start, then rule order."""
    docs, restore = shielded(docs, "doc_id", "text")
    names = docs.columns
    indexed = [r for r in rules if trigram_query(r.regex)]
    found = stored(candidates(postings(docs, rules), rules), "secret-candidates")
    keys = sized(found.select(F.col("doc_id").alias("_id"), F.col("kinds").alias("_kinds")), broadcast_rows)
    out = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    text, none = F.coalesce(F.col("text"), F.lit("")), F.array().cast("array<struct<start:bigint,end:bigint,rank:int,kind:string>>")
    each = []
    for order, rule in enumerate(rules):
        spans = spans_of(text, rule, order)
        each.append(F.when(F.array_contains("_kinds", rule.kind), spans).otherwise(none) if rule in indexed else spans)
    merged = F.concat(*each)
    ranked = F.array_sort(F.transform(merged, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"))))
    ordered = F.transform(ranked, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["rank"].alias("rank"), x["kind"].alias("kind")))
    return restore(out.select(*names, F.when(F.size(merged) > 0, ordered).otherwise(none).alias("secrets")), "secrets")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[secret]", **options) -> DataFrame:
    """docs with every span of text replaced by mark (overlapping spans as one) and n_chars kept right, if present."""
    names = docs.columns
    docs, restore = shielded(docs, "doc_id", "text", "n_chars")
    found = find_secrets(docs, **options)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(x["start"] - acc["at"], F.lit(0)).cast("int"))
        fresh = F.concat(acc["text"], gap, F.lit(mark))
        return F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), fresh.alias("text"))).otherwise(
            F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["text"].alias("text"))
        )

    folded = F.aggregate(F.col("secrets"), start, step)
    clean = F.concat(folded["text"], F.substr(F.col("text"), (folded["at"] + 1).cast("int"), F.char_length("text")))
    new = F.when(F.size("secrets") > 0, clean).otherwise(F.col("text"))
    out = found.withColumn("text", new)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return restore(out)
