"""Approximate nearest neighbours by stable projections and a kd-tree (operator 9).

Vectors are projected on a few Gaussian (2-stable) directions: for two vectors at distance D, the squared distance of
their projections over D squared follows a chi-square law with as many degrees of freedom as directions. A kd-tree over
the projections yields leaves in order of their distance to the query's projection; their vectors are verified with the
true measure until the stopping test holds: had a vector nearer than the k-th best so far been left out, its projection
would lie within the distance reached with probability ``SURE``.

Largest inner product is nearest neighbour once each vector gets one more component that brings all to the same length
(sqrt(M^2 - |x|^2), 0 for queries): distance^2 = |q|^2 + M^2 - 2 <q, x>. M is the largest length in the shard.

Every row is indexed. Rows are dealt to shards by a hash of their id, queries go to every shard in blocks, so a task holds
one shard and one block; each returns the k best of its shard, and a window keeps the k best overall. Equal vectors of a
shard are indexed once with their smallest k + 1 ids, which is all that k results can show. Scores of results are
sums of products in double precision, component by component, so equal vectors score equally.

Nulls: rows whose vector is null, empty, zero, of another length than most, or holds null or non-finite components, and rows with a null id
take no part. A repeated id is one candidate for each row. Ties go to the smaller id. Fewer candidates than k: all are
returned. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Directions of the projection, vectors of a leaf, certainty of the stopping test, seed of the directions.
DIRECTIONS, LEAF, SURE, SEED = 12, 32, 0.25, 20
#: Rows of a shard and queries of a block: what one task holds.
SHARD_ROWS, BLOCK_QUERIES = 40_000, 4_000


def chi_square_quantile(p: float, m: int) -> float:
    """x with P(chi-square of m degrees <= x) = p, by bisection on the regularised lower gamma series."""

    def below(x: float) -> float:
        a, h = m / 2, x / 2
        term = total = 1 / a
        i = 1
        while term > 1e-15 * total:
            term *= h / (a + i)
            total += term
            i += 1
        return total * math.exp(-h + a * math.log(h) - math.lgamma(a))

    low, high = 1e-9, 10.0 * m + 50
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


class Tree:
    """A kd-tree whose leaves are runs of rows with bounding boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        cuts, stack = [], [(0, len(points))]
        while stack:
            a, b = stack.pop()
            if b - a <= leaf:
                cuts.append((a, b))
                continue
            own = self.order[a:b]
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            mid = (b - a) // 2
            self.order[a:b] = own[np.argpartition(points[own, axis], mid)]
            stack += [(a, a + mid), (a + mid, b)]
        self.leaves = np.array(sorted(cuts), np.int64)
        sorted_points = points[self.order]
        self.low = np.minimum.reduceat(sorted_points, self.leaves[:, 0], axis=0)
        self.high = np.maximum.reduceat(sorted_points, self.leaves[:, 0], axis=0)

    def reach(self, q: np.ndarray) -> np.ndarray:
        """Squared distance from q to each leaf's box."""
        return (np.maximum(np.maximum(self.low - q, q - self.high), 0) ** 2).sum(1)


def _exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * q[j]
    return total


class Index:
    """One shard: distinct vectors, their smallest ids, and the tree over their projections."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int, directions: int = DIRECTIONS, seed: int = SEED):
        own = np.ascontiguousarray(x, np.float64)
        keys = np.ascontiguousarray(x, np.float32).view(np.dtype((np.void, 4 * x.shape[1]))).ravel() if x.dtype == np.float32 else own.view(np.dtype((np.void, 8 * x.shape[1]))).ravel()
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        order = np.lexsort((ids, inverse))
        starts = np.flatnonzero(np.r_[True, np.diff(inverse[order]) != 0])
        sizes = np.diff(np.r_[starts, len(ids)])
        rank = np.arange(len(ids)) - np.repeat(starts, sizes)
        keep = rank <= k  # one more than k: the query itself may be among them
        self.ids, self.k = ids[order][keep], k
        self.starts = np.r_[0, np.cumsum(np.minimum(sizes, k + 1))]
        self.x = own[first]
        norms = np.sqrt((self.x**2).sum(1))
        self.most = float(norms.max())
        full = np.hstack([self.x, np.sqrt(np.maximum(self.most**2 - norms**2, 0))[:, None]])
        self.axes = np.random.default_rng(seed).standard_normal((full.shape[1], directions))
        self.tree = Tree(full @ self.axes)
        self.sorted = self.x[self.tree.order]
        self.factor = chi_square_quantile(SURE, directions)

    def search(self, query_id: int, q: np.ndarray) -> list[tuple[float, int]]:
        """The k nearest of the shard: (score, id), best first."""
        k, tree = self.k, self.tree
        reach = tree.reach(np.append(q, 0.0) @ self.axes)
        order = np.argsort(reach, kind="stable")
        length = float(q @ q) + self.most**2
        rows: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        at, step, kth = 0, max(4, len(order) // 12), -np.inf
        while at < len(order):
            if kth > -np.inf:
                gap = max(length - 2 * kth, 0.0)
                if reach[order[at]] > self.factor * gap and reach[order[at]] > 0:
                    break
            part = np.concatenate([np.arange(a, b) for a, b in tree.leaves[order[at : at + step]]])
            rows.append(part)
            scores.append(self.sorted[part] @ q)
            at += step
            best = np.concatenate(scores)
            if len(best) > k:
                kth = float(np.partition(best, len(best) - k - 1)[len(best) - k - 1])  # k and the query itself
        part, best = np.concatenate(rows), np.concatenate(scores)
        if len(best) > k + 1:
            least = np.partition(best, len(best) - k - 1)[len(best) - k - 1]
            keep = best >= least - 1e-9 * max(1.0, abs(least))
            part = part[keep]
        own = tree.order[part]
        exact = _exact(self.x[own], q)
        found = [(-s, int(i)) for s, d in zip(exact.tolist(), own.tolist()) for i in self.ids[self.starts[d] : self.starts[d + 1]] if i != query_id]
        found.sort()
        return [(-s, i) for s, i in found[:k]]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v): rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(good, F.lit(False)))


def search(
    vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector: str = "embedding",
    shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`."""
    rows = usable(vectors, id_col, vector)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    schema = "query_id long, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == sizes["d"])
    shards = max(1, -(-sizes["count"] // shard_rows))
    queries = rows.where(F.col("id") % every == 0)
    blocks = max(1, -(-queries.count() // block_queries))
    shard = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")
    left = rows.select("id", "v", shard.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    right = queries.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), block.alias("b"))
    found = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(_searched(k, sizes["d"]), schema)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(k: int, width: int):
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(data) and len(queries):
            matrix = lambda t: t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            index = Index(data.column("id").to_numpy(), matrix(data), k)
            for query_id, q in sorted(zip(queries.column("id").to_pylist(), matrix(queries)), key=lambda x: x[0]):
                out.extend((query_id, i, s) for s, i in index.search(query_id, q))
        cols = list(zip(*out)) if out else [()] * 3
        kinds = (pa.int64(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["query_id", "vec_id", "score"])

    return run
