"""Fidelity grades against natural variation between real splits, flags and verdicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How many times the natural variation still is a warning.
TOLERANCE = 3.0
FLAG = "metric string, status string, value double, deviation double, train_val double, train_test double, val_test double, natural_variation double"


def ratio_deviation(a: Column, b: Column) -> Column:
    """|a / b - 1|; null if either is missing or b is almost zero."""
    return F.when(F.abs(b) >= 1e-10, F.abs(F.try_divide(a, b) - 1))


def natural_variation(*references: Column) -> Column:
    return F.greatest(*references) if len(references) > 1 else references[0]


def nv_status(value: Column, nv: Column, k: float = TOLERANCE) -> Column:
    return F.when(nv.isNull() | value.isNull(), "warn").when(value <= nv, "pass").when(value <= k * nv, "warn").otherwise("fail")


def flags_from(wide: DataFrame, metric: Column, value: str, kind: str = "ratio", scale: str | None = None) -> DataFrame:
    """FLAG rows from <value>_<split> columns. kind: ratio deviation, absolute difference, or difference over |train|."""
    s, t, v, x = (F.col(f"{value}_{n}") for n in ("synth", "train", "val", "test"))
    far = {"ratio": ratio_deviation, "diff": lambda a, b: F.abs(a - b), "relative": lambda a, b: F.try_divide(F.abs(a - b), F.abs(t))}[kind]
    refs = [far(t, v), far(t, x), far(v, x)]
    nv, dev = natural_variation(*refs), far(s, t)
    shown = F.try_divide(s, t) if kind == "ratio" else s - t
    return wide.select(metric.alias("metric"), nv_status(dev, nv).alias("status"), shown.alias("value"), dev.alias("deviation"), refs[0].alias("train_val"), refs[1].alias("train_test"), refs[2].alias("val_test"), nv.alias("natural_variation"))


def worst_flag(wide: DataFrame, keys: list[str], metric: Column, value: str, count: str | None = None, least: int = 10, kind: str = "ratio") -> DataFrame:
    """One FLAG row for each keys group from its worst member; members under `least` rows in synth or train are left out."""
    rows = wide
    if count is not None:
        rows = rows.where((F.col(f"{count}_synth") >= least) & (F.col(f"{count}_train") >= least))
    each = flags_from(rows, metric, value, kind)
    grouped = each.groupBy("metric").agg(
        F.max_by("value", "deviation").alias("value"), F.max("deviation").alias("deviation"), F.max("train_val").alias("train_val"), F.max("train_test").alias("train_test"), F.max("val_test").alias("val_test"), F.max("natural_variation").alias("natural_variation")
    )
    return grouped.select("metric", nv_status(F.col("deviation"), F.col("natural_variation")).alias("status"), "value", "deviation", "train_val", "train_test", "val_test", "natural_variation")


def rmse_flag(wide: DataFrame, metric: Column, value: str = "mean", least: int = 1) -> DataFrame:
    """FLAG rows from profiles with <value>_<split> columns: RMSE over the points that both splits have."""
    s, t, v, x = (F.col(f"{value}_{n}") for n in ("synth", "train", "val", "test"))
    rmse = lambda a, b: F.when(F.count(a - b) >= least, F.sqrt(F.avg(F.pow(a - b, 2))))
    g = wide.groupBy(metric.alias("metric")).agg(rmse(s, t).alias("deviation"), rmse(t, v).alias("train_val"), rmse(t, x).alias("train_test"), rmse(v, x).alias("val_test"))
    nv = natural_variation(F.col("train_val"), F.col("train_test"), F.col("val_test"))
    return g.select("metric", nv_status(F.col("deviation"), nv).alias("status"), F.col("deviation").alias("value"), "deviation", "train_val", "train_test", "val_test", nv.alias("natural_variation"))


def all_flags(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def verdict(flags: DataFrame) -> DataFrame:
    """Counts by status and the overall verdict: fail if any fails, else warn if any warns, else pass."""
    count = lambda s: F.count_if(F.col("status") == s)
    out = flags.agg(F.count(F.lit(1)).alias("metrics"), count("pass").alias("passed"), count("warn").alias("warned"), count("fail").alias("failed"))
    return out.withColumn("overall", F.when(F.col("failed") > 0, "fail").when(F.col("warned") > 0, "warn").otherwise("pass"))


def fixed_status(ratio: Column, ok: tuple[float, float] = (0.8, 1.2), warn: tuple[float, float] = (0.5, 2.0)) -> Column:
    return F.when(ratio.between(*ok), "pass").when(ratio.between(*warn), "warn").otherwise("fail")
