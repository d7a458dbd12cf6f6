"""Training of the count model over shards, as the sequence model's trainer goes over them: epoch by epoch, with held-out losses.

Counts merge: the model after k shards is the sum of the counts of the first k in a seeded order. So the counts are taken once, by
shard, and the losses of all epochs come from running sums, without a loop over the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pairs import hash_bits
from .sequences import best_epoch

#: Weight of a context's back-off, in observations.
ALPHA = 2.0


def shard_order(shards: DataFrame, seed: int = 42) -> DataFrame:
    """(shard, epoch): the order in which shards are read, from 1. A shard is a row: there are few."""
    return shards.select("shard").distinct().withColumn("epoch", F.row_number().over(Window.orderBy(hash_bits("shard", seed=seed), "shard")))


def shard_transitions(tokens: DataFrame, context: list[str], key: str = "household_id", order: str = "ts", token: str = "token") -> DataFrame:
    """(shard, context..., prev, next, n) of tokens with the shard of their household."""
    prev = F.lag(token).over(Window.partitionBy("shard", key).orderBy(order))
    rows = tokens.select("shard", *context, prev.alias("prev"), F.col(token).alias("next")).where("prev is not null and next is not null")
    return rows.groupBy("shard", *context, "prev", "next").agg(F.count(F.lit(1)).alias("n"))


def _upto(counts: DataFrame, wanted: DataFrame, keys: list[str], epochs: DataFrame, name: str) -> DataFrame:
    """(keys..., epoch, name): for each wanted key and epoch, the counts of the key's rows of that epoch and those before."""
    own = counts.groupBy(*keys, "epoch").agg(F.sum("n").alias("n"))
    grid = wanted.select(*keys).distinct().crossJoin(F.broadcast(epochs.select("epoch")))  # a row an epoch
    upto = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(own, [*keys, "epoch"], "left").withColumn(name, F.coalesce(F.sum("n").over(upto), F.lit(0))).drop("n")


def losses(counts: DataFrame, held_out: DataFrame, context: list[str], bins: int, seed: int = 42, alpha: float = ALPHA) -> DataFrame:
    """(epoch, shard, n_train, loss): mean negative log probability of held_out(context..., prev, next, n) after each epoch.

    p(next | context, prev) backs off to p(next | prev), and that to all bins alike: (n + alpha * back-off) / (N + alpha)."""
    epochs = shard_order(counts, seed)
    own = counts.join(F.broadcast(epochs), "shard")  # a row a shard
    wanted = held_out.groupBy(*context, "prev", "next").agg(F.sum("n").alias("k"))
    rows = wanted.crossJoin(F.broadcast(epochs))
    for keys, name in (([*context, "prev", "next"], "_n1"), ([*context, "prev"], "_t1"), (["prev", "next"], "_n0"), (["prev"], "_t0")):
        rows = rows.join(_upto(own, wanted, keys, epochs, name), [*keys, "epoch"])
    base = (F.col("_n0") + alpha / bins) / (F.col("_t0") + alpha)
    p = (F.col("_n1") + alpha * base) / (F.col("_t1") + alpha)
    out = rows.groupBy("epoch", "shard").agg((-F.sum(F.log(p) * F.col("k")) / F.sum("k")).alias("loss"))
    sizes = own.groupBy("epoch").agg(F.sum("n").alias("_s"))
    upto = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row an epoch
    return out.join(sizes.select("epoch", F.sum("_s").over(upto).alias("n_train")), "epoch").select("epoch", "shard", "n_train", "loss")


def train(counts: DataFrame, held_out: DataFrame, context: list[str], bins: int, patience: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(model, history): the counts up to the best epoch before the first stop, and losses with better, is_best and stopped.

    Training stops once `patience` epochs have passed without a strict improvement; a context without rows never trains."""
    every = losses(counts, held_out, context, bins, seed).cache()  # a row an epoch
    marked = best_epoch(every.select("epoch", "loss"), patience)
    stop = marked.where("stopped").agg(F.min("epoch")).first()[0]
    history = every.select("epoch", "shard", "n_train").join(marked.where(F.lit(stop is None) | (F.col("epoch") <= (stop or 0))), "epoch")
    best = history.orderBy("loss", "epoch").select("epoch").first()
    used = shard_order(counts, seed).where(F.col("epoch") <= (best["epoch"] if best else 0))
    model = counts.join(F.broadcast(used), "shard").groupBy(*context, "prev", "next").agg(F.sum("n").alias("n"))
    return model, history.withColumn("is_best", F.col("epoch") == (best["epoch"] if best else 0))
