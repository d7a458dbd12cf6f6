"""Connected components of an edge table by repeated contraction, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): each node of edges(a, b) with the smallest node of its component.

    Every round hangs each node on its smallest neighbour and contracts the edges along these pointers; what a round
    leaves is stored, and the pointers of all rounds are composed at the end. Stars are gone after one round, chains
    after a number that grows with the logarithm of their length."""
    left = stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        rounds.append(stored(up, "pointers"))
        x = rounds[-1].select(F.col("node").alias("a"), F.col("up").alias("ua"))
        y = rounds[-1].select(F.col("node").alias("b"), F.col("up").alias("ub"))
        moved = left.join(x, "a").join(y, "b").where("ua <> ub")
        last, left = left, stored(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
        discard(last)
    labels = rounds[0].select("node", F.col("up").alias("comp"))
    for up in rounds[1:]:
        step = up.select(F.col("node").alias("_n"), "up")
        labels = labels.join(step, F.col("comp") == F.col("_n"), "left").select("node", F.coalesce("up", "comp").alias("comp"))
    labels = stored(labels, "labels")
    discard(left, *rounds)
    return labels
