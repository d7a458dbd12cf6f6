"""Training windows over token series, and the count model that stands in for the neural sequence model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def month_windows(tokens: DataFrame, length: int, features: list[str], targets: list[str], sos: dict[str, Column | int], key: str = "household_id", order: str = "ts", seed: int = 42) -> DataFrame:
    """One window of length + 1 rows a household and month: (key, month, start, x, y), arrays of `length` rows.

    The start is a hash-uniform position such that the month's first row lies inside; the first row's tokens are the start
    token; x holds rows 0 to length - 1, y the targets of rows 1 to length. Windows beyond the series are left out."""
    w = Window.partitionBy(key).orderBy(order)
    pos = tokens.withColumn("_p", F.row_number().over(w) - 1)
    firsts = pos.groupBy(key, "month").agg(F.min("_p").alias("_f"))
    last = pos.groupBy(key).agg(F.max("_p").alias("_l"))
    low = F.greatest(F.lit(0), F.col("_f") - length)
    high = F.least(F.col("_f"), F.col("_l") - length)
    starts = firsts.join(last, key).where(high >= low).withColumn("start", (low + F.pmod(F.xxhash64(key, "month", F.lit(seed)), high - low + 1)).cast("int"))
    starts = starts.select(key, F.col("month").alias("_m"), "start")
    rows = pos.join(starts, key).where((F.col("_p") >= F.col("start")) & (F.col("_p") <= F.col("start") + length))
    first = F.col("_p") == F.col("start")
    cells = [F.when(first, F.lit(sos[c]) if not isinstance(sos[c], Column) else sos[c]).otherwise(F.col(c)).cast("int") if c in sos else F.col(c).cast("int") for c in features]
    seq = rows.groupBy(key, F.col("_m").alias("month"), "start").agg(F.array_sort(F.collect_list(F.struct("_p", F.array(*cells).alias("x"), F.array(*[F.col(c).cast("int") for c in targets]).alias("y")))).alias("s"))  # length + 1 rows
    return seq.select(key, "month", "start", F.transform(F.slice("s", 1, length), lambda r: r["x"]).alias("x"), F.transform(F.slice("s", 2, length), lambda r: r["y"]).alias("y"))


def fixed_windows(tokens: DataFrame, length: int, column: str, key: str = "household_id", order: str = "ts") -> DataFrame:
    """Blocks of `length` tokens that don't overlap, with the tokens one step on; incomplete blocks are left out."""
    w = Window.partitionBy(key).orderBy(order)
    rows = tokens.select(key, F.row_number().over(w).alias("_p"), F.col(column).alias("t"), F.lead(column).over(w).alias("n")).where("n IS NOT NULL")
    rows = rows.withColumn("block", F.floor((F.col("_p") - 1) / length).cast("int"))
    out = rows.groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct("_p", "t", "n"))).alias("s")).where(F.size("s") == length)
    return out.select(key, "block", F.transform("s", lambda r: r["t"]).alias("x"), F.transform("s", lambda r: r["n"]).alias("y"))


def flat_windows(windows: DataFrame, features: list[str], key: str = "household_id") -> DataFrame:
    """(key, month, pos, feature, token): the tensor as rows."""
    return windows.select(key, "month", F.posexplode("x").alias("pos", "v")).select(key, "month", "pos", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in features]), "v")).alias("feature", "token"))


# count model


def transitions(tokens: DataFrame, context: list[str], token: str = "token", key: str = "household_id", order: str = "ts") -> DataFrame:
    """(context..., prev, next, n): how often a token follows another in a context, within a household."""
    prev = F.lag(token).over(Window.partitionBy(key).orderBy(order))
    rows = tokens.select(*context, prev.alias("prev"), F.col(token).alias("next")).where("prev IS NOT NULL AND next IS NOT NULL")
    return rows.groupBy(*context, "prev", "next").agg(F.count(F.lit(1)).alias("n"))


def probabilities(counts: DataFrame, context: list[str], bins: int, smoothing: float = 0.5) -> DataFrame:
    """counts with p: additive smoothing over `bins` tokens."""
    total = F.sum("n").over(Window.partitionBy(*context, "prev"))
    return counts.withColumn("p", (F.col("n") + smoothing) / (total + smoothing * bins)).withColumn("p_other", F.lit(smoothing) / (total + smoothing * bins))


def cross_entropy(model: DataFrame, tokens: DataFrame, context: list[str], bins: int, token: str = "token", key: str = "household_id", order: str = "ts") -> DataFrame:
    """n and mean negative log probability of a held-out series; unseen contexts are uniform, unseen next tokens p_other."""
    prev = F.lag(token).over(Window.partitionBy(key).orderBy(order))
    rows = tokens.select(*context, prev.alias("prev"), F.col(token).alias("next")).where("prev IS NOT NULL AND next IS NOT NULL").groupBy(*context, "prev", "next").agg(F.count(F.lit(1)).alias("k"))
    other = model.groupBy(*context, "prev").agg(F.first("p_other").alias("p_other"))
    j = rows.join(model.select(*context, "prev", "next", "p"), [*context, "prev", "next"], "left").join(other, [*context, "prev"], "left")
    p = F.coalesce("p", "p_other", F.lit(1.0 / bins))
    return j.agg(F.sum("k").alias("n"), (-F.sum(F.log(p) * F.col("k")) / F.sum("k")).alias("loss"))


def value_metrics(rows: DataFrame) -> DataFrame:
    """Token bias, mean absolute token difference, unit MAE and mean ratio of (token, predicted, value, expected) rows."""
    d = F.col("predicted") - F.col("token")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("token_bias"), F.avg(F.abs(d)).alias("token_mad"), F.avg(F.abs(F.col("expected") - F.col("value"))).alias("mae"), F.try_divide(F.avg("expected"), F.avg("value")).alias("mean_ratio"))


def best_epoch(losses: DataFrame, patience: int = 5) -> DataFrame:
    """epoch, loss, is_best, stopped: strict improvements, and the epochs after `patience` of them without one."""
    w = Window.orderBy("epoch")
    before = F.min("loss").over(w.rowsBetween(Window.unboundedPreceding, -1))
    out = losses.withColumn("better", F.coalesce(F.col("loss") < before, F.lit(True)))
    last = F.max(F.when(F.col("better"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = out.withColumn("_wait", F.col("epoch") - last)
    least = F.min("loss").over(Window.partitionBy(F.lit(0)))
    first = F.min(F.when(F.col("loss") == least, F.col("epoch"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("_l", least).select("epoch", "loss", "better", (F.col("epoch") == F.min(F.when(F.col("loss") == F.col("_l"), F.col("epoch"))).over(Window.partitionBy(F.lit(0)))).alias("is_best"), (F.col("_wait") >= patience).alias("stopped"))
