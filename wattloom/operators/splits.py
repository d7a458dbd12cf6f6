"""Splits, strata, shards and samples in hash order: the same members whatever the partitioning.

The order is that of the MD5 of the key and the seed, which SQL engines agree on. Exact ranks in it are dealt by ranges of the hash:
counts of the ranges first, then a rank within each, so no task holds a group."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import hash_bits
from .ranks import quantiles

#: Bits of the hash that order rows; rows of a range within which a task ranks.
BITS, RANKED = 48, 200_000


def hash_order(key: str = "household_id", seed: int = 42) -> list[Column]:
    return [hash_bits(key, seed=seed), F.col(key)]


def hash_rank(df: DataFrame, by: list[str], order: list[str], seed: int = 42, name: str = "_r", rows: int = RANKED) -> DataFrame:
    """df with name: the row's exact rank (from 0) within its group in hash order of the order columns; ties by their values."""
    keys = by or ["_one"]
    base = (df if by else df.withColumn("_one", F.lit(0))).withColumn("_h", hash_bits(*order, seed=seed))
    wide = base.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / rows).alias("_ranges"))
    dealt = base.join(wide if by else F.broadcast(wide), keys)  # one row without groups
    dealt = dealt.withColumn("_range", F.floor(F.col("_h") / F.lit(2.0**BITS) * F.col("_ranges")))
    counts = dealt.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_range")  # a row for each `rows` rows of the group
    before = counts.select(*keys, "_range", (F.sum("_n").over(earlier) - F.col("_n")).alias("_before"))
    own = Window.partitionBy(*keys, "_range").orderBy("_h", *order)
    out = dealt.withColumn("_own", F.row_number().over(own) - 1).join(before, [*keys, "_range"])
    return out.withColumn(name, F.col("_own") + F.col("_before")).select(*df.columns, name)


def assign_splits(households: DataFrame, val: int, test: int, seed: int = 42, key: str = "household_id") -> DataFrame:
    """households with split: exactly val and test of them in hash order, the rest train. Raises if none is left."""
    total = households.count()
    if val + test >= total:
        raise ValueError(f"{val} + {test} households leave none of {total} to train on")
    ranked = hash_rank(households, [], [key], seed)
    return ranked.withColumn("split", F.when(F.col("_r") < val, "val").when(F.col("_r") < val + test, "test").otherwise("train")).drop("_r")


def split_map(households: DataFrame, assignment: DataFrame) -> DataFrame:
    return households.join(assignment.select("household_id", "split"), "household_id", "left").withColumn("split", F.coalesce("split", F.lit("unassigned")))


def energy_tiers(df: DataFrame, use: str = "use", low: float = 0.33, high: float = 0.66) -> DataFrame:
    """df with tier: up to the first quantile low, up to the second medium, else high."""
    cuts = quantiles(df, [], use, {"_low": low, "_high": high})
    tier = F.when(F.col(use) <= F.col("_low"), "low").when(F.col(use) <= F.col("_high"), "medium").otherwise("high")
    return df.crossJoin(F.broadcast(cuts)).withColumn("tier", tier).drop("_low", "_high")  # one row


def auto_shard_size(tiers: DataFrame, shards: int) -> int:
    """3 * (smallest tier // shards)."""
    return 3 * (tiers.groupBy("tier").count().agg(F.min("count")).first()[0] // shards)


def training_shards(tiers: DataFrame, shards: int, size: int, replace: bool = False, seed: int = 42, key: str = "household_id") -> DataFrame:
    """(shard, household, tier): size // 3 low, as many high, the rest medium in each shard.

    With replacement, slot s of a tier takes the household whose rank is the hash of (tier, s) modulo the tier's size."""
    each = {"low": size // 3, "high": size // 3, "medium": size - 2 * (size // 3)}
    need = F.when(F.col("tier") == "low", each["low"]).when(F.col("tier") == "high", each["high"]).otherwise(each["medium"])
    ranked = hash_rank(tiers.select(key, "tier"), ["tier"], [key], seed)
    if not replace:
        out = ranked.withColumn("shard", F.floor(F.col("_r") / need).cast("int"))
        return out.where(F.col("shard") < shards).select("shard", key, "tier")
    counts = tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("_n"))
    slots = counts.withColumn("slot", F.explode(F.sequence(F.lit(0), need * shards - 1))).withColumn("shard", F.floor(F.col("slot") / need).cast("int"))
    slots = slots.withColumn("_r", F.pmod(hash_bits("tier", "slot", seed=seed), F.col("_n")))
    return slots.join(ranked, ["tier", "_r"]).select("shard", key, "tier")


def sample_rows(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows in hash order; if there are fewer, rows repeat (with replacement) up to n."""
    have = df.count()
    if have >= n or not have:
        return df.orderBy(*hash_order(key, seed)).limit(n)
    times = -(-n // have)
    return df.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).orderBy("_t", *hash_order(key, seed)).limit(n).drop("_t")


def sample_each(df: DataFrame, n: int, by: list[str], order: list[str], seed: int = 42) -> DataFrame:
    """At most n rows of each group, those of the least hashes of the order columns: the reservoir's role, independent of arrival.

    Groups are counted, and only rows under a hash that some n rows of their group are under are ranked: what is sorted is the
    sample, not the group. Should a group have fewer than n under it (as repeated order columns may bring about), the limit doubles."""
    share = (n + 10 * math.sqrt(n) + 100) * 2.0**BITS
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    while True:
        limits = sizes.select(*[F.col(c).alias(f"_{c}") for c in by], "_n", (F.lit(share) / F.col("_n")).alias("_limit"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
        near = df.withColumn("_h", hash_bits(*order, seed=seed)).join(limits, same).where(F.col("_h") < F.col("_limit"))
        short = near.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), F.max("_n").alias("_n"))
        have = sizes.count(), short.where(F.col("k") >= F.least(F.lit(n), F.col("_n"))).count()
        if have[0] == have[1]:
            break
        share *= 2
    w = Window.partitionBy(*by).orderBy("_h", *order)  # some n rows a group
    return near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).select(*df.columns)


def quota_sample(df: DataFrame, quotas: dict[str, dict], key: str = "household_id", seed: int = 42) -> DataFrame:
    """Rows within the quota of any of several strata: {column: {value: quota}}."""
    test, names = F.lit(False), df.columns
    for column, sizes in quotas.items():
        limit = F.coalesce(*[F.when(F.col(column) == v, F.lit(n)) for v, n in sizes.items()], F.lit(0))
        picked = hash_rank(df.where(F.col(column).isNotNull()).select(column, key), [column], [key], seed, f"_q_{column}").where(F.col(f"_q_{column}") < limit)
        df = df.join(picked.select(key).distinct().withColumn(f"_in_{column}", F.lit(True)), key, "left")
        test = test | F.coalesce(f"_in_{column}", F.lit(False))
    return df.where(test).select(*names)


def templates(rows: DataFrame, pool: DataFrame, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """rows with template_id, the household of the pool whose rank is the hash of the row's key modulo the pool's size."""
    ranked = hash_rank(pool.select("household_id").distinct(), [], ["household_id"], seed)
    size = ranked.agg(F.count(F.lit(1)).alias("_n"))
    picked = rows.crossJoin(F.broadcast(size)).withColumn("_r", F.pmod(hash_bits(key, seed=seed), F.greatest("_n", F.lit(1))))  # one row
    return picked.join(ranked.withColumnRenamed("household_id", "template_id"), "_r", "left").drop("_r", "_n")


def split_counts(df: DataFrame) -> DataFrame:
    """split, n, pct to two decimals."""
    total = df.agg(F.count(F.lit(1)).alias("_t"))
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total)).select("split", "n", F.round(100 * F.col("n") / F.col("_t"), 2).alias("pct"))


def shard_sizes(shards: DataFrame) -> DataFrame:
    """smallest, largest, mean and balance (smallest / largest) of shard sizes."""
    return shards.groupBy("shard").count().agg(
        F.min("count").alias("smallest"), F.max("count").alias("largest"), F.avg("count").alias("mean"), F.try_divide(F.min("count"), F.max("count")).alias("balance")
    )
