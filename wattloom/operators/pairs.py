"""Tables of all pairs that never leave their task: blocks of rows meet, and each task returns sums, counts or a sample.

A task holds one block of either side, as matrices. What it returns merges with what other tasks return: moments by the
merge of means and squared deviations, least and most, counts of ranges, or the pairs of the least hashes. Rows returned
grow with the blocks' rows, not with the pairs. A row moves once for each block that it meets: of vectors there are a
fixed number of blocks a side (until a block is too large), so that what moves grows with the rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .ranks import blocks, running
from .shared import stored

#: Least rows of a block of vectors; series of a block within a batch.
BLOCK_ROWS, SERIES_ROWS = 1000, 256
#: Blocks of a side, and bytes of a block from which there are more; tasks of a pass at most.
BLOCKS, BLOCK_BYTES, MOST_PARTS = 12, 64 << 20, 2000
#: Rows of either side whose distances a task computes at once: they stay in a core's cache.
TILE = (128, 1024)
#: Tiles that are sorted at once.
GATHER = 16
#: Ranges that a level of the quantile search cuts a range into; values that its last pass returns; levels at most.
RANGES, VALUES, LEVELS = 1 << 17, 1 << 25, 3
#: Marks whose ranks one pass counts.
MARKS = 1_000_000
#: Odd multipliers of the pair hash, below 2^62 so that SQL's 128-bit integers hold the products.
FACTORS = (0x1F83D9ABFB41BD6B, 0x2B7E151628AED2A7)


def hash_bits(*columns: str | Column, bits: int = 48, seed: int | None = None) -> Column:
    """The first bits (a multiple of 4, at most 60) of the MD5 of the columns' strings joined by ':': SQL engines agree on it."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    text = F.concat_ws(":", *parts, *([F.lit(str(seed))] if seed is not None else []))
    return F.conv(F.substring(F.md5(text), 1, bits // 4), 16, 10).cast("long")


def deal(
    rows: DataFrame, other: DataFrame | None, by: list[str], key: str, block_rows: int, run: Callable[..., pa.Table | None], schema: str,
    parts: int | None = None,
) -> DataFrame:
    """Rows of schema that run(a, b, same) returns for each pair of blocks; within one group (other is None) each unordered
    pair of blocks meets once, and `same` tells a block's meeting with itself. Blocks don't cross the groups of `by`. parts: how many tasks, if not Spark's number."""
    within = other is None
    keys = by or ["_one"]
    left = rows if by else rows.withColumn("_one", F.lit(0))
    right = left.select(*[F.col(c).alias(c) for c in left.columns]) if within else other if by else other.withColumn("_one", F.lit(0))
    count = lambda df, name: df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias(name))
    sizes = count(left, "_n").join(count(right, "_m"), keys) if not within else count(left, "_n").withColumn("_m", F.col("_n"))
    block = lambda n, salt: F.pmod(F.xxhash64(key, F.lit(salt)), F.col(n)).cast("int")
    a = left.join(sizes, keys).withColumn("_i", block("_n", 1))
    a = a.withColumn("_j", F.explode(F.sequence(F.col("_i") if within else F.lit(0), F.col("_m") - 1)))
    b = right.join(sizes, keys).withColumn("_j", block("_m", 1 if within else 2))
    b = b.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_j") if within else F.col("_n") - 1)))
    kinds = [to_arrow_type(f.dataType) for f in rows.sparkSession.createDataFrame([], schema).schema.fields]
    names = [x.split()[0] for x in schema.split(", ")]

    def task(where, one: pa.Table, two: pa.Table) -> pa.Table:
        *_, i, j = (x.as_py() for x in where)
        got = run(one, two, within and i == j) if one.num_rows and two.num_rows else None
        if got is None:
            return pa.table([pa.array([], k) for k in kinds], names)
        return got.select(names).cast(pa.schema(list(zip(names, kinds))))

    a, b = (x.drop("_n", "_m") if parts is None else x.drop("_n", "_m").repartition(parts, *keys, "_i", "_j") for x in (a, b))
    return a.groupBy(*keys, "_i", "_j").cogroup(b.groupBy(*keys, "_i", "_j")).applyInArrow(task, schema)


def _matrix(t: pa.Table, column: str = "x") -> np.ndarray:
    flat = t.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(t.num_rows, -1)


def _ids(t: pa.Table) -> np.ndarray:
    halves = (t.column(c).to_numpy().astype(np.uint64) for c in ("_hi", "_lo"))
    return (next(halves) << np.uint64(32)) | next(halves)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of x's rows to y's, row by row, from the differences."""
    out = np.empty(len(x))
    for at in range(0, len(x), TILE[0]):
        out[at : at + TILE[0]] = ((x[at : at + TILE[0]] - y[at : at + TILE[0]]) ** 2).sum(1)
    return np.sqrt(out)


class Meeting:
    """A pair of blocks in a task, read tile by tile: no more than a tile of distances exists at once.

    Rows are in the order of their ids, so that every pass sees the same tiles and the same last bits."""

    def __init__(self, a: pa.Table, b: pa.Table, same: bool):
        order = [(c, "ascending") for c in ("_hi", "_lo", "k")]
        self.a, self.b, self.same = a.sort_by(order), b.sort_by(order), same
        self.x, self.y = _matrix(self.a), _matrix(self.b)
        self.x2, self.xx, self.yy = -2 * self.x, (self.x * self.x).sum(1), (self.y * self.y).sum(1)
        self.space = np.empty(TILE[0] * TILE[1])
        self.ha, self.hb = _ids(self.a), _ids(self.b)
        self.ka, self.kb = (t.column("k").to_numpy(zero_copy_only=False) for t in (self.a, self.b)) if same else (None, None)

    def tiles(self) -> Iterator[tuple[slice, slice]]:
        for i in range(0, len(self.x), TILE[0]):
            for j in range(0, len(self.y), TILE[1]):
                if not self.same or j + TILE[1] > i:  # below the diagonal no pair counts
                    yield slice(i, min(i + TILE[0], len(self.x))), slice(j, min(j + TILE[1], len(self.y)))

    def valid(self, i: slice, j: slice) -> np.ndarray | None:
        """The pairs that count; None: all."""
        if not self.same:
            return None
        ha, hb = self.ha[i, None], self.hb[j]
        return (ha < hb) | ((ha == hb) & (self.ka[i, None] < self.kb[j]))

    def distances(self, i: slice, j: slice) -> np.ndarray:
        """Euclidean distances by one matrix product; where it cancels, from the differences. Good until the next call."""
        xx, yy = self.xx[i], self.yy[j]
        out = self.space[: len(xx) * len(yy)].reshape(len(xx), len(yy))
        np.matmul(self.x2[i], self.y[j].T, out=out)
        out += xx[:, None]
        out += yy
        top, near = 1e-3 * (xx.max() + yy.max()), None
        if not out.min() >= top:  # NaN neither
            p, q = np.divmod(np.flatnonzero(out < top), len(yy))
            here = out[p, q] < 1e-3 * (xx[p] + yy[q])
            near = p[here], q[here]
        with np.errstate(invalid="ignore"):
            np.sqrt(out, out=out)
        if near is not None:
            x, y = self.x[i], self.y[j]
            for at in range(0, len(near[0]), 1 << 16):
                u, v = (c[at : at + (1 << 16)] for c in near)
                out[u, v] = _apart(x[u], y[v])
        return out

    def counted(self, i: slice, j: slice) -> np.ndarray:
        """The distances of the pairs that count."""
        d, valid = self.distances(i, j), self.valid(i, j)
        return d.ravel() if valid is None else d[valid]


class Distinct:
    """Distinct values with their counts, merged whenever many have come."""

    def __init__(self):
        self.parts, self.held, self.limit = [], 0, 1 << 21

    def add(self, values: np.ndarray) -> None:
        if len(values):
            self.parts.append((values, np.ones(len(values), np.int64)))
            self.held += len(values)
            if self.held > self.limit:
                self.parts = [self.merged()]
                self.held = len(self.parts[0][0])
                self.limit = max(1 << 21, 2 * self.held)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0), np.empty(0, np.int64)
        values, at = np.unique(np.concatenate([v for v, _ in self.parts]), return_inverse=True)
        return values, np.bincount(at, np.concatenate([n for _, n in self.parts]), len(values)).astype(np.int64)


def _ranges(d: np.ndarray, scale: float, path: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distances in the sought ranges, the codes of those ranges, their ranges at the next level).

    A level cuts a range into RANGES equal ones; a code is the numbers of the levels so far. Not decreasing in the distance,
    what is beyond the last range, and NaN, counting to it."""
    at = d * scale
    own, code = np.fmin(at, RANGES - 1).astype(np.int64), None
    for level, sought in enumerate(path):
        if level:
            keep = np.flatnonzero(np.isin(code * RANGES + own, sought))
            code = code[keep] * RANGES + own[keep]
        else:
            first = np.zeros(RANGES, bool)
            first[sought] = True
            keep = np.flatnonzero(first[own])
            code = own[keep]
        d, at = d[keep], (at[keep] - own[keep]) * RANGES
        own = np.fmin(at, RANGES - 1).astype(np.int64)
    return d, code, own


@dataclass(frozen=True)
class Pairs:
    """All pairs of rows(key, x) and other(key, x), or the unordered pairs of rows. Rows without a vector take no part.

    A side is dealt into at most BLOCKS blocks, or as many as BLOCK_BYTES demand: each row moves that often a pass."""

    rows: DataFrame
    other: DataFrame | None = None
    key: str = "id"
    x: str = "x"
    block_rows: int = BLOCK_ROWS

    def _side(self, df: DataFrame) -> DataFrame:
        words = F.md5(F.col(self.key).cast("string"))
        half = lambda at: F.conv(F.substring(words, at, 8), 16, 10).cast("long")
        vectors = df.select(F.col(self.key).alias("k"), F.col(self.x).cast("array<double>").alias("x"), half(1).alias("_hi"), half(9).alias("_lo"))
        return vectors.where("x is not null and size(x) > 0")

    @cached_property
    def sizes(self) -> tuple[int, int, int, float]:
        """Rows of either side, the longest vector's length, and a bound of the distances."""
        norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        top = F.max(F.when(norm < float("inf"), norm))  # NaN is not less
        got = [self._side(df).agg(F.count(F.lit(1)), F.max(F.size("x")), top).first() for df in (self.rows, self.other) if df is not None]
        one, two = got[0], got[-1]
        return one[0], two[0], max(one[1] or 1, two[1] or 1), (one[2] or 0.0) + (two[2] or 0.0)

    @property
    def possible(self) -> int:
        """Pairs, if keys are distinct."""
        n, m, *_ = self.sizes
        return n * m if self.other is not None else n * (n - 1) // 2

    def fold(self, run: Callable[[Meeting], pa.Table | None], schema: str) -> DataFrame:
        """run(meeting) for each pair of blocks."""
        n, m, width, _ = self.sizes
        rows = max(self.block_rows, min(math.ceil(max(n, m) / BLOCKS), BLOCK_BYTES // (8 * width)))
        parts = min(max(1, math.ceil(n / rows) * math.ceil(m / rows)), MOST_PARTS)
        other = None if self.other is None else self._side(self.other)
        return deal(self._side(self.rows), other, [], "k", rows, lambda a, b, same: run(Meeting(a, b, same)), schema, parts)

    def survey(self, by_row: bool = False) -> DataFrame:
        """One pass for all that follows, stored: moments of each pair of blocks (kind 0), counts of the RANGES ranges of
        the distance (1) and, if asked, the sums and least distances of each of rows to other (2)."""
        kind, scale = self.rows.schema[self.key].dataType.simpleString(), self._scale
        names = ["kind", "k", "at", "n", "total", "square", "least", "most"]
        key_type = to_arrow_type(self.rows.schema[self.key].dataType)

        def run(meet: Meeting) -> pa.Table | None:
            counts, parts = np.zeros(RANGES, np.int64), []
            total, least = np.zeros(len(meet.x)), np.full(len(meet.x), np.inf)
            for i, j in meet.tiles():
                if by_row:
                    d = meet.distances(i, j)
                    total[i] += d.sum(1)
                    least[i] = np.fmin(least[i], d.min(1))
                    d = d.ravel()
                else:
                    d = meet.counted(i, j)
                if len(d):
                    mean = d.mean()
                    gap = d - mean
                    parts.append((len(d), len(d) * mean, np.dot(gap, gap), d.min(), d.max()))
                    counts += np.bincount(_ranges(d, scale, [])[2], minlength=RANGES)
            if not parts:
                return None
            n, sums, squares, lows, highs = (np.array(c) for c in zip(*parts))
            mean = sums.sum() / n.sum()
            there = np.flatnonzero(counts)
            own = [pa.table([[0], pa.nulls(1, key_type), [0], [n.sum()], [sums.sum()], [(squares + n * (sums / n - mean) ** 2).sum()], [lows.min()], [highs.max()]], names)]
            none = pa.nulls(len(there), pa.float64())
            own.append(pa.table([np.ones(len(there), np.int64), pa.nulls(len(there), key_type), there, counts[there], none, none, none, none], names))
            if by_row:
                none, zero = pa.nulls(len(total), pa.float64()), np.zeros(len(total), np.int64)
                own.append(pa.table([zero + 2, meet.a.column("k").combine_chunks(), zero, zero + len(meet.y), total, none, least, none], names))
            return pa.concat_tables(own)

        parts = self.fold(run, f"kind long, k {kind}, at long, n long, total double, square double, least double, most double")
        part = F.when(F.col("kind") == 0, F.monotonically_increasing_id())  # moments stay a row for each pair of blocks
        out = parts.withColumn("part", part).groupBy("kind", "part", "k", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("square").alias("square"), F.min("least").alias("least"), F.max("most").alias("most"))
        return stored(out.drop("part"), "pair-survey")

    @property
    def _scale(self) -> float:
        top = self.sizes[3]
        return RANGES / top if top > 0 and math.isfinite(RANGES / top) else 0.0

    def moments(self, survey: DataFrame | None = None) -> DataFrame:
        """One row: n, mean, sd (population), least, most."""
        parts = (self.survey() if survey is None else survey).where("kind = 0")
        whole = parts.agg(F.sum("n").alias("_n"), F.sum("total").alias("_t"))
        gap = F.col("total") / F.col("n") - F.col("_t") / F.col("_n")
        return parts.crossJoin(F.broadcast(whole)).agg(  # a row
            F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (F.sum("total") / F.sum("n")).alias("mean"),
            F.sqrt(F.sum(F.col("square") + F.col("n") * gap * gap) / F.sum("n")).alias("sd"), F.min("least").alias("least"), F.max("most").alias("most"),
        )

    def row_stats(self, survey: DataFrame | None = None) -> DataFrame:
        """(key, n, mean, least) of the distances of each of rows to other."""
        if survey is not None:
            parts = survey.where("kind = 2")
        else:

            def run(meet: Meeting) -> pa.Table:
                total, least = np.zeros(len(meet.x)), np.full(len(meet.x), np.inf)
                for i, j in meet.tiles():
                    d = meet.distances(i, j)
                    total[i] += d.sum(1)
                    least[i] = np.fmin(least[i], d.min(1))
                return pa.table([meet.a.column("k"), np.full(len(total), len(meet.y)), total, least], ["k", "n", "total", "least"])

            kind = self.rows.schema[self.key].dataType.simpleString()
            parts = self.fold(run, f"k {kind}, n long, total double, least double")
        return parts.groupBy(F.col("k").alias(self.key)).agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"), F.min("least").alias("least"))

    def quantiles(self, shares: dict[str, float], survey: DataFrame | None = None) -> DataFrame:
        """One row of exact quantiles, linear between neighbours. The counts of ranges tell in which range a rank lies; one more
        pass returns the distances of those ranges. Ranges that hold more than VALUES are cut again first."""
        spark = self.rows.sparkSession
        survey = self.survey() if survey is None else survey
        counts = survey.where("kind = 1").select(F.col("at").alias("code"), "n").orderBy("code").collect()  # at most RANGES rows
        n = sum(r["n"] for r in counts)
        kind = ", ".join(f"{c} double" for c in shares)
        if not n:
            return spark.createDataFrame([tuple([None] * len(shares))], kind)
        at = {c: s * (n - 1) for c, s in shares.items()}
        ranks = {r: (0, r) for p in at.values() for r in (math.floor(p), math.ceil(p))}  # rank: code of its range, rank in it
        path, scale = [], self._scale
        while True:
            held, found = {}, {}
            for rank, (code, left) in ranks.items():
                own = [r for r in counts if r["code"] // RANGES == code] if path else counts
                for r in own:
                    if left < r["n"]:
                        break
                    left -= r["n"]
                found[rank], held[r["code"]] = (r["code"], min(left, r["n"] - 1)), r["n"]
            ranks, path = found, [*path, np.array(sorted(held), np.int64)]
            if sum(held.values()) <= VALUES or len(path) == LEVELS:
                break

            def cut(meet: Meeting, path=path) -> pa.Table | None:
                codes = Distinct()
                for i, j in meet.tiles():
                    _, code, own = _ranges(meet.counted(i, j), scale, path)
                    codes.add(code * RANGES + own)
                values, n = codes.merged()
                return pa.table([values, n], ["code", "n"]) if len(n) else None

            counts = self.fold(cut, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").collect()  # RANGES for each rank at most

        def pick(meet: Meeting) -> pa.Table | None:
            held = {}
            for i, j in meet.tiles():
                d, code, _ = _ranges(meet.counted(i, j), scale, path)
                for c in np.unique(code):
                    held.setdefault(int(c), Distinct()).add(d[code == c])
            parts = [(c, *v.merged()) for c, v in held.items()]
            return pa.concat_tables([pa.table([np.full(len(v), c), v, n], ["code", "value", "n"]) for c, v, n in parts]) if parts else None

        values = stored(self.fold(pick, "code long, value double, n long").groupBy("code", "value").agg(F.sum("n").alias("n")), "pair-values")
        upto = running(values, ["code"], "value", ["n"])
        holds = lambda r: (F.col("code") == ranks[r][0]) & (F.col("n_upto") - F.col("n") <= ranks[r][1]) & (F.col("n_upto") > ranks[r][1])
        value = upto.agg(*[F.max(F.when(holds(r), F.col("value"))).alias(f"r{r}") for r in ranks]).first()
        low = {c: (value[f"r{math.floor(p)}"], value[f"r{math.ceil(p)}"], p - math.floor(p)) for c, p in at.items()}
        return spark.createDataFrame([tuple(a + (b - a) * part for a, b, part in low.values())], kind)

    def summary(self) -> DataFrame:
        """One row: n, mean, sd, least, q25, median, q75, most, iqr."""
        survey = self.survey()
        q = self.quantiles({"q25": 0.25, "median": 0.5, "q75": 0.75}, survey)
        out = self.moments(survey).crossJoin(F.broadcast(q))  # a row
        return out.select("n", "mean", "sd", "least", "q25", "median", "q75", "most", (F.col("q75") - F.col("q25")).alias("iqr"))

    def below(self, marks: DataFrame, mark: str) -> DataFrame:
        """(mark, below, total): for each distinct value of marks, how many distances are smaller, and how many there are.

        A task sorts some tiles of distances and counts below each mark; marks go to the tasks in parts of about MARKS values."""
        asked = marks.where(F.col(mark).isNotNull()).select(F.col(mark).cast("double").alias("mark")).distinct()
        parts = blocks(asked.count(), MARKS)
        counts = None
        for part in range(parts):
            here = asked.where(F.pmod(F.xxhash64("mark"), F.lit(parts)) == part)
            sent = self.rows.sparkSession.sparkContext.broadcast(np.sort(np.array([r["mark"] for r in here.toLocalIterator()], float)))

            def run(meet: Meeting, sent=sent) -> pa.Table:
                values = sent.value
                below, total, tiles = np.zeros(len(values), np.int64), 0, meet.tiles()
                while some := [meet.counted(i, j).copy() for i, j in islice(tiles, GATHER)]:
                    d = np.sort(np.concatenate(some))
                    below += np.searchsorted(d, values)
                    total += len(d)
                return pa.table([values, below, np.full(len(values), total)], ["mark", "below", "total"])

            none = F.lit(0).cast("long")
            own = self.fold(run, "mark double, below long, total long").unionByName(here.withColumn("below", none).withColumn("total", none))
            counts = own if counts is None else counts.unionByName(own)
        return counts.groupBy(F.col("mark").alias(mark)).agg(F.sum("below").alias("below"), F.sum("total").alias("total"))

    def sample(self, most: int) -> DataFrame:
        """(a, b, h, distance): the `most` pairs of the least hashes h, or all. A uniform sample that merges: each task returns
        its pairs under a hash that about `most` of all are under, whatever the blocks. Within a group, a is the end of the
        smaller MD5. Only the chosen pairs' distances are computed."""
        n, within = self.possible, self.other is None
        kind = self.rows.schema[self.key].dataType.simpleString()
        share = (most + 10 * math.sqrt(most) + 100) / max(n, 1)
        while True:
            limit = min(int(share * 2**63), 2**63 - 1)

            def run(meet: Meeting, limit=limit) -> pa.Table | None:
                factor = [np.uint64(f) for f in FACTORS]
                one, two = (meet.ha * factor[0], meet.hb * factor[1])
                back = (meet.ha * factor[1], meet.hb * factor[0]) if within else None
                at = []
                for i, j in meet.tiles():
                    h = one[i, None] + two[j]
                    if within:
                        h = np.where(meet.ha[i, None] <= meet.hb[j], h, back[0][i, None] + back[1][j])
                    h >>= np.uint64(1)
                    chosen, valid = h <= np.uint64(limit), meet.valid(i, j)
                    p, q = np.nonzero(chosen if valid is None else chosen & valid)
                    if len(p):
                        at.append((p + i.start, q + j.start, h[p, q].astype(np.int64)))
                if not at:
                    return None
                p, q, h = (np.concatenate(c) for c in zip(*at))
                ka, kb = meet.a.column("k").take(pa.array(p)), meet.b.column("k").take(pa.array(q))
                if within:
                    swap = pa.array(meet.ha[p] > meet.hb[q])
                    ka, kb = pc.if_else(swap, kb, ka), pc.if_else(swap, ka, kb)
                return pa.table([ka, kb, h, _apart(meet.x[p], meet.y[q])], ["a", "b", "h", "distance"])

            out = self.fold(run, f"a {kind}, b {kind}, h long, distance double").orderBy("h", "a", "b").limit(most).cache()  # `most` rows
            if limit == 2**63 - 1 or out.count() >= min(most, n):
                return out
            out.unpersist()
            share *= 2


# within batches


def _aligned(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, ...]:
    """Values and presence of both sides' series over the steps of both."""
    steps = [t.column("steps").combine_chunks().flatten() for t in (a, b)]
    code = pa.chunked_array(steps).combine_chunks().dictionary_encode()
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    index, width, out, at = code.indices.to_numpy(), len(code.dictionary), [], 0
    for t in (a, b):
        sizes = np.diff(t.column("values").combine_chunks().offsets.to_numpy())
        row = np.repeat(np.arange(t.num_rows), sizes)
        values, there = np.zeros((t.num_rows, width)), np.zeros((t.num_rows, width))
        own = index[at : at + len(row)]
        values[row, own], there[row, own] = t.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False), 1
        at += len(row)
        out += [values, there]
    return tuple(out)


def _series(df: DataFrame, keys: list[str], step: str, value: str) -> DataFrame:
    """keys, household_id, steps and values of each household's series in step order: readings move once."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(step).alias("s"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))))
    return df.groupBy(*keys, "household_id").agg(pairs.alias("_p")).select(*keys, "household_id", F.col("_p.s").alias("steps"), F.col("_p.v").alias("values"))


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _valid(a: pa.Table, b: pa.Table, same: bool) -> np.ndarray:
    if not same:
        return np.ones((a.num_rows, b.num_rows), bool)
    ids = [t.column("household_id").to_numpy(zero_copy_only=False) for t in (a, b)]
    return ids[0][:, None] < ids[1]


def _keyed(a: pa.Table, keys: list[str], row: dict) -> pa.Table:
    return pa.table([a.column(k).slice(0, 1) for k in keys] + [[v] for v in row.values()], [*keys, *row])


def batch_correlations(df: DataFrame, keys: list[str], step: str = "step", high: float = 0.95, value: str = "value") -> DataFrame:
    """Per key: households that vary, mean and largest correlation of their pairs over common steps, pairs above `high`.

    Nulls count as 0. Correlations come from matrix products of a block's series."""
    mean = F.aggregate("values", F.lit(0.0), lambda s, v: s + v) / F.size("values")
    series = _series(df, keys, step, value).withColumn("values", F.transform("values", lambda v: v - mean))
    live = series.where(F.exists("values", lambda v: v != F.element_at("values", 1)))

    def run(a, b, same):
        x, mx, y, my = _aligned(a, b)
        n = mx @ my.T
        sx, sy, xx, yy = x @ my.T, mx @ y.T, (x * x) @ my.T, mx @ (y * y).T
        with np.errstate(all="ignore"):
            cov, vx, vy = (x @ y.T) / n - sx * sy / n**2, xx / n - (sx / n) ** 2, yy / n - (sy / n) ** 2
            flat = (vx <= 1e-14 * xx / n) | (vy <= 1e-14 * yy / n)  # constant over the common steps
            r = np.where(flat, np.nan, cov / np.sqrt(vx * vy))
        r = r[_valid(a, b, same) & (n > 0)]
        met, r = len(r), r[~np.isnan(r)]
        row = {"met": met, "pairs": len(r), "total": float(r.sum()), "most": float(r.max()) if len(r) else None, "high": int((r > high).sum())}
        return _keyed(a, keys, row) if met else None

    parts = deal(live, None, keys, "household_id", SERIES_ROWS, run, f"{_key_schema(df, keys)}, met long, pairs long, total double, most double, high long")
    return parts.groupBy(*keys).agg(
        F.sum("pairs").alias("pairs"), F.try_divide(F.sum("total"), F.sum("pairs")).alias("mean_corr"), F.max("most").alias("max_corr"), F.sum("high").alias("high_pairs")
    )


def batch_distances(df: DataFrame, keys: list[str], step: str = "step", near: float = 0.01, value: str = "value") -> DataFrame:
    """Per key: mean and least Euclidean distance of series scaled by their mean absolute value, pairs under `near` of the mean.

    Two passes over the blocks: the mean first, then the pairs under its share."""
    size = F.aggregate("values", F.lit(0.0), lambda s, v: s + F.abs(v)) / F.size("values")
    series = _series(df, keys, step, value).withColumn("values", F.transform("values", lambda v: F.coalesce(F.try_divide(v, size), F.lit(0.0))))

    def distances(a, b, same):
        x, mx, y, my = _aligned(a, b)
        xx, yy = (x * x) @ my.T, mx @ (y * y).T
        square = xx + yy - 2 * (x @ y.T)
        valid = _valid(a, b, same) & (mx @ my.T > 0)
        i, j = np.nonzero(valid & (square < 1e-3 * (xx + yy)))
        square[i, j] = [(((x[p] - y[q]) * mx[p] * my[q]) ** 2).sum() for p, q in zip(i, j)]
        return np.sqrt(np.maximum(square, 0))[valid]

    def first(a, b, same):
        d = distances(a, b, same)
        return _keyed(a, keys, {"n": len(d), "total": float(d.sum()), "least": float(d.min())}) if len(d) else None

    def second(a, b, same):
        d = distances(a, b, same)
        return _keyed(a, keys, {"n": int((d < near * a.column("_mean")[0].as_py()).sum())}) if len(d) else None

    schema = _key_schema(df, keys)
    parts = deal(series, None, keys, "household_id", SERIES_ROWS, first, f"{schema}, n long, total double, least double")
    mean = parts.groupBy(*keys).agg((F.sum("total") / F.sum("n")).alias("mean_distance"), F.min("least").alias("least_distance"))
    with_mean = series.join(mean.select(*keys, F.col("mean_distance").alias("_mean")), keys)
    close = deal(with_mean, None, keys, "household_id", SERIES_ROWS, second, f"{schema}, n long").groupBy(*keys).agg(F.sum("n").alias("near_identical"))
    return mean.join(close, keys).select(*keys, "mean_distance", "least_distance", "near_identical")
