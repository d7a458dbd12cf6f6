"""Companion extracts of an evaluation: long tables, one a figure, after disclosure control.

Each takes the sections of evaluate() and carries the numbers of households of each split: synthetic ones as they are, those
of real splits rounded to tens. A column is <split>_<value> where an extract shows splits side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import privacy, stats
from ..operators.ranks import quantiles

SPLITS = ("synth", "train", "val", "test")
#: Bins of the histogram of differences; a bin with fewer values of train is suppressed.
BINS, LEAST = 79, 10


def _households(s: dict[str, DataFrame]) -> DataFrame:
    """One row: n_households_<split>, rounded for real splits."""
    counts = privacy.real_rounded(s["totals"], ["households"])
    return counts.agg(*[F.coalesce(F.max(F.when(F.col("split") == x, F.col("households"))), F.lit(0)).alias(f"n_households_{x}") for x in SPLITS])


def _with_households(df: DataFrame, s: dict[str, DataFrame], splits: tuple[str, ...] = SPLITS) -> DataFrame:
    return df.crossJoin(F.broadcast(_households(s).select(*[f"n_households_{x}" for x in splits])))  # one row


def _own_households(df: DataFrame, s: dict[str, DataFrame]) -> DataFrame:
    own = privacy.real_rounded(s["totals"], ["households"]).select("split", F.col("households").alias("n_households"))
    return df.join(F.broadcast(own), "split", "left")  # a row a split


def _side_by_side(df: DataFrame, keys: list[str], values: dict[str, str], splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """keys and <split>_<name> for each value: name."""
    out = df.groupBy(*keys).agg(*[F.max(F.when(F.col("split") == x, F.col(v))).alias(f"{x}_{n}" if n else x) for v, n in values.items() for x in splits])
    return out


def marginal(readings: DataFrame, s: dict[str, DataFrame]) -> DataFrame:
    """fuel, split, mean, std, n_obs, p5 to p95, n_households."""
    names = ["fuel", "split", "mean", F.col("sd").alias("std"), F.col("n").alias("n_obs"), *[f"p{q}" for q in stats.QUANTILES]]
    return _own_households(stats.fuel_stats(readings, "split", "fuel").where("mean is not null").select(*names), s)


def conditional(s: dict[str, DataFrame]) -> DataFrame:
    """fuel, cond_var, cond_value, suppressed, and by split households, mean, std and the ratio of synth's mean to a real one's.

    A group of a fuel in which a real split has 1 to 9 households is suppressed in all splits."""
    keys = ["fuel", "cond_var", "cond_value"]
    wide = _side_by_side(s["conditional"], keys, {"households": "n", "mean": "mean", "sd": "std"})
    small = reduce(lambda a, b: a | b, [privacy.small_count(F.col(f"{x}_n")) for x in privacy.REAL])
    shown = lambda c: F.when(~F.col("suppressed"), c)
    out = wide.withColumn("suppressed", small)
    ratio = lambda x: F.try_divide(F.col("synth_mean"), F.nullif(F.col(f"{x}_mean"), F.lit(0.0)))
    return out.select(
        *keys, "suppressed", F.coalesce("synth_n", F.lit(0)).alias("n_households_synth"), *[shown(privacy.round_ten(F.coalesce(f"{x}_n", F.lit(0)))).alias(f"n_households_{x}") for x in privacy.REAL],
        *[shown(F.col(f"{x}_{v}")).alias(f"{x}_{v}") for x in SPLITS for v in ("mean", "std")], *[shown(ratio(x)).alias(f"{x}_ratio") for x in privacy.REAL],
    )


def acf(s: dict[str, DataFrame]) -> DataFrame:
    """fuel, lag, a column a split, train_diff, households."""
    wide = _side_by_side(s["acf"], ["fuel", "lag"], {"mean": ""})
    return _with_households(wide.withColumn("train_diff", F.col("synth") - F.col("train")), s)


def profiles(profile: DataFrame, s: dict[str, DataFrame]) -> DataFrame:
    """fuel, day_type, half_hour, means of all splits, medians of synth and train, households. profile: daily_profile by split, fuel."""
    wide = _side_by_side(profile, ["fuel", "day_type", "half_hour"], {"mean": "mean", "median": "median"})
    return _with_households(wide.drop("val_median", "test_median"), s)


def volatility(s: dict[str, DataFrame]) -> DataFrame:
    """fuel, quantile (p50, p75, p90 of absolute differences), synth, train, test, households."""
    rows = F.explode(F.array(*[F.struct(F.lit(q).alias("quantile"), F.col(q).alias("v")) for q in ("p50", "p75", "p90")]))
    long = s["volatility"].select("split", "fuel", rows.alias("_q")).select("split", "fuel", "_q.quantile", "_q.v")
    shown = ("synth", "train", "test")
    return _with_households(_side_by_side(long, ["fuel", "quantile"], {"v": ""}, shown), s, shown)


def volatility_histogram(diffs: DataFrame, s: dict[str, DataFrame], bins: int = BINS) -> DataFrame:
    """fuel, bin, its edges, counts and densities of differences in synth, train and test.

    Bins are equal ones between minus and plus the 99th percentile of synth's absolute differences, the last one closed; a bin
    with fewer than LEAST differences of train is suppressed. All differences count, no sample of them."""
    shown = ("synth", "train", "test")
    edge = quantiles(diffs.where("split = 'synth'").select("fuel", F.abs("diff").alias("d")), ["fuel"], "d", {"most": 0.99})
    inside = diffs.join(F.broadcast(edge), "fuel").where((F.abs("diff") <= F.col("most")) & (F.col("most") > 0))  # a row a fuel
    width = 2 * F.col("most") / bins
    at = F.least(F.floor((F.col("diff") + F.col("most")) / width), F.lit(bins - 1)).cast("int")
    counts = inside.groupBy("fuel", "most", at.alias("bin")).agg(*[F.count_if(F.col("split") == x).alias(f"{x}_n") for x in shown])
    grid = edge.where("most > 0").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts.drop("most"), ["fuel", "bin"], "left").fillna(0, [f"{x}_n" for x in shown])
    totals = full.groupBy("fuel").agg(*[F.sum(f"{x}_n").alias(f"{x}_all") for x in shown])
    full = full.join(F.broadcast(totals), "fuel").withColumn("suppressed", F.col("train_n") < LEAST)  # a row a fuel
    visible = lambda c: F.when(~F.col("suppressed"), c)
    density = lambda x: visible(F.try_divide(F.col(f"{x}_n"), F.col(f"{x}_all") * width))
    count = lambda x: visible(F.col(f"{x}_n") if x == "synth" else privacy.round_ten(F.col(f"{x}_n")))
    out = full.select(
        "fuel", "bin", (F.col("bin") * width - F.col("most")).alias("bin_left"), ((F.col("bin") + 1) * width - F.col("most")).alias("bin_right"), "suppressed",
        *[count(x).alias(f"{x}_count") for x in shown], *[density(x).alias(f"{x}_density") for x in shown],
    )
    return _with_households(out, s, shown)


def ptg(s: dict[str, DataFrame]) -> DataFrame:
    """fuel, split, month, mean_temperature, mean_consumption, n_households."""
    return _own_households(s["ptg"].select("fuel", "split", "month", F.col("temperature").alias("mean_temperature"), F.col("consumption").alias("mean_consumption")), s)


def seasonal(s: dict[str, DataFrame]) -> DataFrame:
    """fuel, split, month, mean, median, std, ci_lower, ci_upper, n_households."""
    own = s["seasonal"].select("fuel", "split", "month", "mean", "median", F.col("sd").alias("std"), F.col("low").alias("ci_lower"), F.col("high").alias("ci_upper"))
    return _own_households(own, s)
