"""Household-month features, distances between groups, privacy checks, within-batch variance."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import adjusted_kurtosis, adjusted_skew
from .compare import student_p
from .pairs import Pairs
from .ranks import quantiles
from .shared import stored
from .stats import differences, rolling_sd

#: Hours of the day's parts: from, to.
TIME_BINS = {"night": (0, 6), "morning": (6, 12), "afternoon": (12, 18), "evening": (18, 24)}
QUANTILES = (5, 25, 50, 75, 95)
FEATURES = [
    "mean", "std", "max", "min", "skew", "kurtosis", *[f"q{q}" for q in QUANTILES], "peak_hour", *[f"{b}_avg" for b in TIME_BINS], "first_diff_mean", "first_diff_std",
    "rolling_volatility_mean", "rolling_volatility_std", "load_factor", "weekday_weekend_ratio", "missing_pct", "zeros_pct",
]


def household_month_features(df: DataFrame, keys: list[str], order: list[str], rolling: int = 7 * 48, value: str = "value") -> DataFrame:
    """keys and FEATURES, a row for each key with at least one value. Half-hours are 1 to 48 on both sides."""
    v = F.col(value)
    q = F.percentile(value, F.array(*[F.lit(x / 100) for x in QUANTILES]))
    base = df.groupBy(*keys).agg(
        F.count(v).alias("n_values"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.max(v).alias("max"), F.min(v).alias("min"), adjusted_skew(v).alias("skew"), adjusted_kurtosis(v).alias("kurtosis"), q.alias("_q"),
        F.avg(F.when(F.col("dow") < 5, v)).alias("_wd"), F.avg(F.when(F.col("dow") >= 5, v)).alias("_we"), (100 * F.avg(v.isNull().cast("int"))).alias("missing_pct"), (100 * F.avg(F.coalesce(v == 0, F.lit(False)).cast("int"))).alias("zeros_pct"),
    ).where("n_values > 0")
    slots = df.groupBy(*keys, "half_hour").agg(F.avg(v).alias("m"))
    h = F.col("half_hour") - 1
    timing = slots.groupBy(*keys).agg(
        F.floor(F.max_by(h, F.when(F.col("m").isNotNull(), F.struct(F.col("m"), -h))) / 2).cast("int").alias("peak_hour"),
        *[F.avg(F.when((h >= 2 * a) & (h < 2 * b), F.col("m"))).alias(f"{n}_avg") for n, (a, b) in TIME_BINS.items()],
    )
    diff = differences(df, keys, order, value).groupBy(*keys).agg(F.avg("diff").alias("first_diff_mean"), F.stddev_samp("diff").alias("first_diff_std"))
    roll = rolling_sd(df, keys, order, rolling, value).groupBy(*keys).agg(F.avg("vol").alias("rolling_volatility_mean"), F.stddev_samp("vol").alias("rolling_volatility_std"))
    out = base.join(timing, keys, "left").join(diff, keys, "left").join(roll, keys, "left")
    return out.select(
        *keys, "n_values", "mean", "std", "max", "min", "skew", "kurtosis", *[F.col("_q")[i].alias(f"q{x}") for i, x in enumerate(QUANTILES)], "peak_hour", *[f"{b}_avg" for b in TIME_BINS],
        "first_diff_mean", "first_diff_std", "rolling_volatility_mean", "rolling_volatility_std", F.when(F.col("max") > 0, F.col("mean") / F.col("max")).alias("load_factor"),
        F.when(F.col("_we") > 0, F.col("_wd") / F.col("_we")).alias("weekday_weekend_ratio"), "missing_pct", "zeros_pct",
    )


def standardised(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """keep and x: array of population z-scores; nulls take the column's mean (0 if it has none), a constant column gives 0."""
    moments = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns])
    filled = df.crossJoin(F.broadcast(moments)).select(*keep, *[F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}"), F.lit(0.0)).alias(c) for c in columns])
    both = filled.agg(*[x for c in columns for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    z = F.array(*[F.coalesce(F.try_divide(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.col(c) - F.col(f"m_{c}")) for c in columns])
    return filled.crossJoin(F.broadcast(both)).select(*keep, z.alias("x"))


def privacy_leakage(synth: DataFrame, train: DataFrame, test: DataFrame, key: str = "id", x: str = "x") -> DataFrame:
    """Per synthetic row: mean and least distance to train and test, their difference, nearer to train, high risk (least
    distance to train under its 25th percentile)."""
    a, b = (Pairs(synth, other, key, x).row_stats().select(key, F.col("mean").alias(f"mean_{n}"), F.col("least").alias(f"least_{n}")) for other, n in ((train, "train"), (test, "test")))
    out = stored(a.join(b, key), "leakage")  # a row a synthetic row, of two passes over all pairs
    cut = quantiles(out, [], "least_train", {"_c": 0.25})
    return out.crossJoin(F.broadcast(cut)).select(
        key, "mean_train", "mean_test", "least_train", "least_test", (F.col("mean_train") - F.col("mean_test")).alias("diff"), (F.col("least_train") < F.col("least_test")).alias("nearer_train"), (F.col("least_train") < F.col("_c")).alias("high_risk")
    )


def memorisation(leakage: DataFrame) -> dict:
    """Paired t-test of the mean distances: t, p, Cohen's d, and whether p < 0.05 with train nearer."""
    r = leakage.agg(F.count("diff").alias("n"), F.avg("diff").alias("m"), F.stddev_samp("diff").alias("s")).first()
    if not r["n"] or r["n"] < 2 or not r["s"]:
        return {"n": r["n"], "mean_diff": r["m"], "t": None, "p": None, "cohens_d": None, "memorised": False}
    t = r["m"] / (r["s"] / math.sqrt(r["n"]))
    p = student_p(t, r["n"] - 1)
    return {"n": r["n"], "mean_diff": r["m"], "t": t, "p": p, "cohens_d": r["m"] / r["s"], "memorised": p < 0.05 and r["m"] < 0}


def outlier_flags(pairs: Pairs) -> DataFrame:
    """(key, mean, outlier): rows whose mean distance is above the 95th percentile of all distances."""
    survey = pairs.survey(by_row=True)
    cut = pairs.quantiles({"cut": 0.95}, survey)
    means = pairs.row_stats(survey).select(pairs.key, "mean").crossJoin(F.broadcast(cut))  # a row
    return stored(means.select(pairs.key, "mean", (F.col("mean") > F.col("cut")).alias("outlier")), "outliers")


def outliers(pairs: Pairs) -> DataFrame:
    """outlier_flags with the percentile rank of the means among all distances (left search)."""
    flags = outlier_flags(pairs)
    out = flags.join(pairs.below(flags, "mean"), "mean")
    return out.select(pairs.key, "mean", (100 * F.col("below") / F.col("total")).alias("percentile"), "outlier")


def distance_distributions(groups: dict[str, Pairs], most: int = 50_000) -> DataFrame:
    """(type, a, b, distance): for each type of pairs at most `most`, those of the least hashes."""
    out = None
    for name, pairs in groups.items():
        own = pairs.sample(most).select(F.lit(name).alias("type"), "a", "b", "distance")
        out = own if out is None else out.unionByName(own)
    return out


def paired_share(leakage: DataFrame) -> DataFrame:
    return leakage.agg(F.avg((F.col("diff") > 0).cast("int")).alias("above"), F.avg((F.col("diff") < 0).cast("int")).alias("below"))


def distance_report(leak: DataFrame, out: DataFrame) -> DataFrame:
    a = leak.agg(F.count(F.lit(1)).alias("rows"), F.count_if("high_risk").alias("high_risk"), F.count_if("nearer_train").alias("nearer_train"))
    return a.crossJoin(F.broadcast(out.agg(F.count_if("outlier").alias("outliers"))))


def pca(rows: DataFrame, keep: list[str], x: str = "x", k: int = 2) -> tuple[DataFrame, list[list[float]], list[float]]:
    """(keep and pc: array of k, loadings, explained variance). Signs are free."""
    width = rows.select(F.size(x)).first()[0]
    means = rows.agg(F.array(*[F.avg(F.col(x)[i]) for i in range(width)]).alias("_m"))
    centred = rows.crossJoin(F.broadcast(means)).select(*keep, array_to_vector(F.zip_with(x, "_m", lambda a, b: a - b)).alias("v"))
    model = PCA(k=k, inputCol="v", outputCol="p").fit(centred)
    return model.transform(centred).select(*keep, vector_to_array("p").alias("pc")), model.pc.toArray().tolist(), model.explainedVariance.toArray().tolist()


# within one batch


def peak_diversity(df: DataFrame, keys: list[str], step: str = "step", value: str = "value") -> DataFrame:
    """Per key: distinct peak steps of its households and the share of the commonest. Nulls count as 0, first peak on ties."""
    v = F.coalesce(value, F.lit(0.0))
    peaks = df.groupBy(*keys, "household_id").agg(F.max_by(step, F.struct(v, -F.col(step))).alias("peak"))
    per = peaks.groupBy(*keys, "peak").agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(*keys).agg(F.sum("k").alias("households"), F.count(F.lit(1)).alias("distinct_peaks"), F.try_divide(F.max("k"), F.sum("k")).alias("concentration"))


def overfitting(df: DataFrame, fuels: tuple[str, ...] = ("elec", "gas")) -> DataFrame:
    """df with n_flags and severity from <fuel>_high_pairs, _mean_corr, _near_identical and _concentration."""
    n = F.lit(0)
    for f in fuels:
        for test in (F.col(f"{f}_high_pairs") > 0, F.col(f"{f}_mean_corr") > 0.8, F.col(f"{f}_near_identical") > 0, F.col(f"{f}_concentration") > 0.7):
            n = n + F.coalesce(test, F.lit(False)).cast("int")
    return df.withColumn("n_flags", n).withColumn("severity", F.when(n == 0, "none").when(n <= 2, "low").when(n <= 4, "medium").otherwise("high"))


def variance_report(flagged: DataFrame) -> DataFrame:
    """Counts by severity and the verdict: fail with any high, warn with more than a tenth medium."""
    count = lambda s: F.count_if(F.col("severity") == s)
    out = flagged.agg(F.count(F.lit(1)).alias("batches"), *[count(s).alias(s) for s in ("none", "low", "medium", "high")])
    return out.withColumn("status", F.when(F.col("high") > 0, "fail").when(F.col("medium") > 0.1 * F.col("batches"), "warn").otherwise("pass"))


def worst_batches(flagged: DataFrame, k: int = 20, key: str = "batch_id") -> DataFrame:
    return flagged.where("n_flags > 0").orderBy(F.desc("n_flags"), key).limit(k)
