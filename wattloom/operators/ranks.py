"""Running sums and exact quantiles over all rows of a group, dealt by ranges of the value: no task holds a whole group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

#: Ranges that a group is dealt into; rows of ranges, counted, up to which they are broadcast.
RANGES, BROADCAST_ROWS = 64, 500_000


def running(df: DataFrame, by: list[str], value: str, counts: list[str], ranges: int = RANGES) -> DataFrame:
    """df with, for each count column c, <c>_upto (its sum over the group's rows up to the value) and <c>_all, and <value>_next.

    Rows are unique by group and value. Ranges are cut at approximate quantiles, which decides only who works on what."""
    keys = by or ["_one"]
    df = df if by else df.withColumn("_one", F.lit(0))
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / ranges) for i in range(1, ranges)]), 2000).alias("_cuts"))
    cuts = stored(cuts, "range-cuts") if by else cuts  # without groups one row
    own = F.broadcast if not by or cuts.count() * ranges <= BROADCAST_ROWS else (lambda x: x)
    v = F.col(value)
    dealt = df.join(own(cuts), keys).withColumn("_r", F.size(F.filter("_cuts", lambda c: c < v))).drop("_cuts")  # a row a group
    parts = dealt.groupBy(*keys, "_r").agg(*[F.sum(c).alias(f"_{c}") for c in counts], F.min(value).alias("_least"))
    w = Window.partitionBy(*keys).orderBy("_r")  # at most `ranges` rows a group
    whole = Window.partitionBy(*keys)
    parts = parts.select(
        *keys, "_r", F.lead("_least").over(w).alias("_after"),
        *[(F.sum(f"_{c}").over(w) - F.col(f"_{c}")).alias(f"_{c}_before") for c in counts], *[F.sum(f"_{c}").over(whole).alias(f"{c}_all") for c in counts],
    )
    inside = Window.partitionBy(*keys, "_r").orderBy(value)
    out = dealt.join(own(parts), [*keys, "_r"])  # `ranges` rows a group
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.select(
        *df.columns, *[(F.col(f"_{c}_before") + F.sum(c).over(upto)).alias(f"{c}_upto") for c in counts], *[f"{c}_all" for c in counts],
        F.coalesce(F.lead(value).over(inside), F.col("_after")).alias(f"{value}_next"),
    ).drop("_one")


def quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(by..., one column for each name of shares): exact quantiles, linear between neighbouring values. Nulls don't count."""
    values = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    at = running(values, by, value, ["n"])

    def pick(share: float) -> Column:
        rank = F.lit(share) * (F.col("n_all") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        holds = lambda r: (F.col("n_upto") - F.col("n") <= r) & (r < F.col("n_upto"))
        a, b = (F.max(F.when(holds(r), F.col(value))) for r in (low, high))
        return a + (b - a) * F.max(rank - low)

    return at.groupBy(*by).agg(*[pick(s).alias(name) for name, s in shares.items()])


def ranks(values: DataFrame, marks: DataFrame, value: str, key: str) -> DataFrame:
    """(key, below, total): for each of marks(key, value), how many rows of values have a smaller value, and how many there are."""
    counted = values.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("mark"))
    asked = marks.where(F.col(value).isNotNull()).groupBy(value).agg(F.lit(0).cast("long").alias("n"), F.lit(1).alias("mark"))
    both = counted.unionByName(asked).groupBy(value).agg(F.sum("n").alias("n"), F.max("mark").alias("mark"))
    at = running(both, [], value, ["n"]).where("mark = 1").select(value, (F.col("n_upto") - F.col("n")).alias("below"), F.col("n_all").alias("total"))
    return marks.select(key, value).join(at, value).select(key, "below", "total")


def blocks(n: int, rows: int) -> int:
    return max(1, math.ceil(n / rows))
