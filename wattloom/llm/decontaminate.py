"""Benchmark decontamination over a positional inverted index (operator 6), in DataFrame expressions only.

1. ``postings`` stores (term, row, pos) for every word of every document that is a word of the benchmark; a row is a hash of
   doc_id and text. Texts are cut into words once for it, and the terms' corpus frequencies are counted from it.
2. A window is WIDTH consecutive words of an item (a shorter item is one window; windows of an item that read alike count
   once). Each window names its rarest words by corpus frequency, MORE more than may differ: whatever differs in a
   match, as many agree. As windows overlap, so do their choices, and all but the words that may differ of those
   chosen places that lie in a window must agree.
3. Offsets are taken off: a posting at pos of a word at place p of an item lies on diagonal pos - p. Postings meet by
   document (they are shuffled once, before they meet the items), and a band of BAND neighbouring diagonals of a document
   is a candidate if as many such places of an item are on it or beside it as a window that holds one of them needs.
4. Candidates return to their documents, where the item's words around these places are compared on each diagonal, in
   time linear in their number. Runs of equal words of a window or more are exact hits. Stretches of windows of which all
   but a few words (2 of 10, 1 of 5 to 9) stand at their place or one beside it are proximity matches, so a word may be
   replaced, inserted or left out inside; those that only overhang a hit of the same item are left out.

Benchmark tables and candidate lists are broadcast only if their counted size allows it; else they are shuffled by
term or row. Nothing grows with pairs of documents.

Nulls: a null text has no words; a null doc_id is a key like any other; a null item_id counts as the id "". Items or
documents without words match nothing. Equal rows share candidates. Repeated items count once per item_id. Empty tables
give empty results or no hits. Other columns are not read.

Where only exact hits are asked for, ``find_phrases`` finds them over an index of fewer terms, chosen by counts taken first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, shielded, sized, stored, words

#: Fixed by the query's contract: words of a window.
WIDTH = 10
#: Words that must agree for a proximity match.
NEAR = 8
#: Rarest words that a window names beyond those that may differ.
MORE = 3
#: Rarest words that a window names where nothing may differ.
PHRASE = 2
#: Diagonals that are grouped.
BAND = 4

_SPANS = "array<struct<item:string,start:int,end:int>>"


def items_of(benchmark: DataFrame) -> DataFrame:
    """(k, item, ws): distinct word lists of the items that have words, with a key."""
    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    out = benchmark.select(item.alias("item"), words(F.coalesce("text", F.lit(""))).alias("ws")).where(F.size("ws") > 0)
    return out.distinct().select(F.xxhash64("item", "ws").alias("k"), "item", "ws")


def postings(docs: DataFrame, terms: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """(t, row, pos) of the given terms(term, t) in all of docs(row, text)."""
    tokens = docs.select("row", F.posexplode(words(F.col("text"))).alias("pos", "term"))
    return tokens.join(sized(terms, broadcast_rows), "term").select("t", "row", "pos")


def spare(w: Column, width: int = WIDTH, near: int = NEAR) -> Column:
    """How many of a window's w words may differ in a proximity match."""
    return F.floor(w * (width - near) / width).cast("int")


def rare_places(items: DataFrame, tf: DataFrame, width: int = WIDTH, near: int = NEAR, more: int = MORE) -> DataFrame:
    """(k, need, place, t): the places in the item that are, for some window, among its rarest, `more` more than may differ.

    tf: (term, t, tf). Windows with more words that never occur than may differ are left out. need: of these places, how
    many at least a match of any window that holds this place has. Ties go to the earlier."""
    n = F.size("ws")
    w = F.least(n, F.lit(width))
    starts = F.sequence(F.lit(0), n - w)
    windows = items.select("k", w.alias("w"), F.posexplode(F.transform(starts, lambda s: F.slice("ws", s + 1, w))).alias("s", "g"))
    windows = windows.groupBy("k", "w", "g").agg(F.min("s").alias("s"))
    placed = windows.select("k", "w", "s", F.posexplode("g").alias("i", "term")).join(tf, "term", "left")
    each = placed.groupBy("k", "w", "s").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("tf", F.lit(0)).alias("tf"), "i", "t"))).alias("r"))
    may = spare(F.col("w"), width, near)  # r: at most `width` words
    each = each.withColumn("spare", may - F.size(F.filter("r", lambda x: x["tf"] == 0))).where("spare >= 0")
    rarest = F.filter(F.slice("r", F.lit(1), may + more), lambda x: x["tf"] > 0)
    places = each.select("k", F.explode(F.transform(rarest, lambda x: F.struct((F.col("s") + x["i"]).alias("place"), x["t"].alias("t")))).alias("x")).select("k", "x.*").distinct()
    inside = each.select("k", "spare", "s", F.explode(F.sequence(F.col("s"), F.col("s") + F.col("w") - 1)).alias("place")).join(places, ["k", "place"])
    chosen = F.count(F.lit(1)).over(Window.partitionBy("k", "s"))  # at most `width` rows
    return inside.withColumn("n", chosen).groupBy("k", "place", "t").agg(F.min(F.greatest(F.col("n") - F.col("spare"), F.lit(1))).alias("need"))


def diagonals(index: DataFrame, places: DataFrame, width: int = WIDTH, broadcast_rows: int = 500_000) -> DataFrame:
    """(row, k, low, high, p, q): diagonals, at most BAND + 2, on which a document and an item may share a window, and the places met."""
    own = index.join(sized(places.select("t").distinct(), broadcast_rows), "t", "left_semi").repartition("row")
    on = own.join(sized(places, broadcast_rows), "t").withColumn("diag", F.col("pos") - F.col("place"))
    first, last = F.floor((F.col("diag") - 1) / BAND).cast("int"), F.floor((F.col("diag") + 1) / BAND).cast("int")
    on = on.select("row", "k", "need", "place", "diag", F.explode(F.sequence(first, last)).alias("band"))
    met = on.groupBy("row", "k", "band").agg(
        F.min("need").alias("need"), F.min("place").alias("p"), F.max("place").alias("q"), F.count(F.lit(1)).alias("n"),
        F.min("diag").alias("d"), F.max("diag").alias("e"),
    ).where(f"n >= need AND (need = 1 OR p < q) AND (q - p < {width} OR n > need)")
    low, high = F.greatest(F.col("band") * BAND, F.col("d") - 1), F.least(F.col("band") * BAND + BAND - 1, F.col("e") + 1)
    return met.select("row", "k", low.alias("low"), high.alias("high"), "p", "q")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(flags: Column, w: Column) -> Column:
    """array<struct<start, end>>: maximal runs of at least w true flags."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("run"), F.array().cast(kind).alias("out"))

    def step(acc: Column, i: Column) -> Column:
        on = F.coalesce(F.get(flags, i), F.lit(False))
        ended = F.concat(acc["out"], F.array(F.struct((i - acc["run"]).alias("start"), i.alias("end"))))
        out = F.when(~on & (acc["run"] >= w), ended).otherwise(acc["out"])
        return F.struct(F.when(on, acc["run"] + 1).otherwise(F.lit(0)).alias("run"), out.alias("out"))

    return F.aggregate(F.sequence(F.lit(0), F.size(flags)), zero, step)["out"]


def _stretches(flags: Column, w: Column, need: Column) -> Column:
    """array<struct<start, end>>: unions of overlapping windows of w flags of which at least `need` are true."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("n"), F.lit(-1).alias("from"), F.lit(-1).alias("to"), F.array().cast(kind).alias("out"))
    on = lambda i: F.coalesce(F.get(flags, i).cast("int"), F.lit(0))

    def step(acc: Column, i: Column) -> Column:
        n = acc["n"] + on(i) - F.when(i >= w, on(i - w)).otherwise(F.lit(0))
        enough = (n >= need) & (i >= w - 1) & (i < F.size(flags))
        fresh = enough & ((acc["from"] < 0) | (i - w + 1 > acc["to"]))
        ends = (fresh | (i == F.size(flags))) & (acc["from"] >= 0)
        out = F.when(ends, F.concat(acc["out"], F.array(F.struct(acc["from"].alias("start"), acc["to"].alias("end"))))).otherwise(acc["out"])
        return F.struct(
            n.alias("n"), F.when(fresh, i - w + 1).otherwise(acc["from"]).alias("from"), F.when(enough, i + 1).otherwise(acc["to"]).alias("to"), out.alias("out")
        )

    return F.aggregate(F.sequence(F.lit(0), F.size(flags)), zero, step)["out"]


def _compared(c: Column, d: Column, width: int, near: int) -> Column:
    """array<struct<item, start, end, exact>> of candidate c on diagonal d; _pad has two words before and after the document's."""
    n, size = F.size(c["ws"]), F.size("_ws")
    w = F.least(F.lit(width), c["n"])
    need = w - spare(w, width, near)
    at = d + c["first"]  # where the candidate's first word would stand
    place = lambda i: F.get("_pad", at + i + 2)

    def beside(i: Column) -> Column:
        word = F.get(c["ws"], i)
        return F.coalesce((place(i) == word) | (place(i - 1) == word) | (place(i + 1) == word), F.lit(False))

    def spans(flags: Column) -> Column:
        same = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(flags, i) & F.coalesce(place(i) == F.get(c["ws"], i), F.lit(False)))
        tell = lambda exact: lambda x: F.struct(
            c["item"].alias("item"), F.greatest(at + x["start"], F.lit(0)).alias("start"), F.least(at + x["end"], size).alias("end"), F.lit(exact).alias("exact")
        )
        both = F.concat(F.transform(_let(same, lambda x: _runs(x, w)), tell(True)), F.transform(_stretches(flags, w, need), tell(False)))
        enough = F.size(F.filter(flags, lambda x: x)) >= need
        return F.when(enough, both).otherwise(F.array().cast(_SPANS.replace("end:int", "end:int,exact:boolean")))

    return _let(F.transform(F.sequence(F.lit(0), n - 1), beside), spans)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, near: int = NEAR, broadcast_rows: int = 500_000
) -> DataFrame:
    """docs with the columns n_words, hits and near: array<struct<item, start, end>>, end exclusive, in words."""
    docs, restore = shielded(docs, "doc_id", "text")
    names = docs.columns
    row = F.xxhash64("doc_id", "text")
    items = stored(items_of(benchmark), "bench-items")
    terms = stored(items.select(F.explode("ws").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "bench-terms")
    index = stored(postings(docs.select(row.alias("row"), "text"), terms, broadcast_rows), "positional-index")
    tf = terms.join(index.groupBy("t").agg(F.count(F.lit(1)).alias("tf")), "t")
    places = stored(rare_places(items, tf, width, near), "bench-windows")
    found = diagonals(index, places, width, broadcast_rows)
    found = found.join(sized(items.withColumn("n", F.size("ws")), broadcast_rows), "k")
    first, last = F.greatest(F.col("p") - (width - 1), F.lit(0)), F.least(F.col("q") + width, F.col("n"))
    one = F.struct("item", "n", first.alias("first"), F.slice("ws", first + 1, last - first).alias("ws"), "low", "high")
    lists = stored(found.select("row", one.alias("c")).groupBy(F.col("row").alias("_row")).agg(F.collect_list("c").alias("_cands")), "bench-candidates")
    discard(index, places, terms, items)
    out = docs.join(sized(lists, broadcast_rows), row == F.col("_row"), "left")
    out = out.select(*names, "_cands", words(F.coalesce("text", F.lit(""))).alias("_ws"))
    blank = F.array(F.lit(""), F.lit(""))
    out = out.withColumn("_pad", F.when(F.col("_cands").isNotNull(), F.concat(blank, "_ws", blank)))
    each = lambda c: F.flatten(F.transform(F.sequence(c["low"], c["high"]), lambda d: _compared(c, d, width, near)))
    close = F.when(F.col("_cands").isNotNull(), F.flatten(F.transform("_cands", each)))
    out = out.select(*names, F.size("_ws").cast("long").alias("n_words"), close.alias("_close"))
    plain = lambda exact: F.array_distinct(F.transform(F.filter("_close", lambda x: x["exact"] == exact), lambda x: F.struct(x["item"], x["start"], x["end"])))
    out = out.select(*names, "n_words", *[F.coalesce(plain(x), F.array()).cast(_SPANS).alias(c) for x, c in ((True, "hits"), (False, "_near"))])
    over = width - near
    covered = lambda x: F.exists("hits", lambda h: (h["item"] == x["item"]) & (h["start"] - over <= x["start"]) & (x["end"] <= h["end"] + over))
    return restore(out.select(*names, "n_words", "hits", F.filter("_near", lambda x: ~covered(x)).alias("near")), "n_words", "hits", "near")


def find_phrases(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, broadcast_rows: int = 500_000) -> DataFrame:
    """docs with the columns n_words and hits as of find_leaks: exact phrases only, from a smaller index.

    The corpus frequencies of the benchmark's words are counted first. Only postings of words that are among the PHRASE rarest of
    some window are stored then; a diagonal is a candidate if all such places of a window meet on it. Candidates carry hashes of
    the item's words, and runs of equal hashes of a window or more are the hits (64 bits a word, ten of them a window)."""
    docs, restore = shielded(docs, "doc_id", "text")
    names = docs.columns
    row = F.xxhash64("doc_id", "text")
    items = stored(items_of(benchmark), "bench-items")
    terms = stored(items.select(F.explode("ws").alias("term")).distinct().withColumn("t", F.monotonically_increasing_id()), "bench-terms")
    tokens = docs.select(F.explode(words(F.col("text"))).alias("term")).join(sized(terms, broadcast_rows), "term")
    tf = tokens.groupBy("term", "t").agg(F.count(F.lit(1)).alias("tf"))
    places = stored(rare_places(items, tf, width, width, PHRASE), "bench-windows")
    chosen = terms.join(places.select("t").distinct(), "t", "left_semi")
    index = stored(postings(docs.select(row.alias("row"), "text"), chosen, broadcast_rows), "positional-index")
    on = index.join(sized(places, broadcast_rows), "t").withColumn("diag", F.col("pos") - F.col("place"))
    found = on.groupBy("row", "k", "diag").agg(
        F.min("need").alias("need"), F.min("place").alias("p"), F.max("place").alias("q"), F.count(F.lit(1)).alias("n")
    ).where("n >= need")
    hashed = items.select("k", "item", F.size("ws").alias("size"), F.transform("ws", lambda x: F.xxhash64(x)).alias("hs"))
    found = found.join(sized(hashed, broadcast_rows), "k")
    first, last = F.greatest(F.col("p") - (width - 1), F.lit(0)), F.least(F.col("q") + width, F.col("size"))
    one = F.struct("item", F.least(F.lit(width), F.col("size")).alias("w"), (F.col("diag") + first).alias("at"), F.slice("hs", first + 1, last - first).alias("hs"))
    lists = stored(found.select("row", one.alias("c")).groupBy(F.col("row").alias("_row")).agg(F.collect_list("c").alias("_cands")), "bench-candidates")
    discard(index, places, terms, items)
    out = docs.join(sized(lists, broadcast_rows), row == F.col("_row"), "left")
    out = out.select(*names, "_cands", words(F.coalesce("text", F.lit(""))).alias("_ws"))

    def spans(c: Column, own: Column) -> Column:
        same = F.transform(c["hs"], lambda h, i: F.coalesce(F.get(own, c["at"] + i) == h, F.lit(False)))
        tell = lambda x: F.struct(c["item"].alias("item"), (c["at"] + x["start"]).alias("start"), (c["at"] + x["end"]).alias("end"))
        return _let(same, lambda flags: F.transform(_runs(flags, c["w"]), tell))

    # the document's hashes are bound once: as a column they would be made anew for each word they are compared with
    found = _let(F.transform("_ws", lambda x: F.xxhash64(x)), lambda own: F.flatten(F.transform("_cands", lambda c: spans(c, own))))
    hits = F.when(F.col("_cands").isNotNull(), F.array_distinct(found))
    out = out.select(*names, F.size("_ws").cast("long").alias("n_words"), F.coalesce(hits, F.array()).cast(_SPANS).alias("hits"))
    return restore(out, "n_words", "hits")


def hit_words(hits: Column) -> Column:
    """Number of distinct words inside any hit."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    spans = F.array_sort(F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))))
    step = lambda acc, h: F.struct(
        (acc["n"] + F.greatest(h["end"] - F.greatest(h["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], h["end"]).alias("to")
    )
    return F.aggregate(spans, zero, step)["n"].cast("long")


def item_list(hits: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["item"])))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs without any exact hit, with their columns."""
    docs, restore = shielded(docs, "doc_id", "text")
    # a row number in the test keeps it from being moved below, where the words of a text would be cut anew for each comparison
    found = find_phrases(docs, benchmark, **options).withColumn("_row", F.monotonically_increasing_id())
    return restore(found.where((F.size("hits") == 0) & (F.col("_row") >= 0)))
