"""Diagnostics of synthetic readings against real ones, and the suite that runs them all.

Each diagnostic is a function of readings with split and gives named tables. The suite runs each on its own: one that fails is
recorded with its error and the others go on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compare, stats
from ..operators.ranks import quantiles

#: Percentiles of household-month means.
SHARES = (20, 40, 60, 80)
REPORT = "diagnostic string, position int, status string, result string, rows long, error string"


def household_month_fidelity(readings: DataFrame, context: list[str]) -> DataFrame:
    """Means of household-months by fuel and split, of all and by each value of each context variable.

    cond_var and cond_value are null for all; n months, households, mean with sample sd, standard error and 95 % interval,
    quintiles of the means. Unknown values of a variable form no group."""
    months = readings.groupBy("split", "fuel", "household_id", "month", *context).agg(F.avg("value").alias("v")).where("v is not null")
    named = [F.struct(F.lit(None).cast("string").alias("cond_var"), F.lit(None).cast("string").alias("cond_value"))]
    named += [F.struct(F.lit(c).alias("cond_var"), F.col(c).cast("string").alias("cond_value")) for c in context]
    long = months.select("split", "fuel", "household_id", "v", F.explode(F.array(*named)).alias("_c")).select("split", "fuel", "household_id", "v", "_c.*")
    long = long.where("cond_var is null or cond_value is not null")
    # nulls stand for all rows, so they are names of their own while groups are joined
    key = F.concat_ws("=", F.coalesce("cond_var", F.lit("")), F.coalesce("cond_value", F.lit("")))
    long = long.withColumn("_g", key)
    by = ["split", "fuel", "_g"]
    moments = long.groupBy(*by).agg(
        F.first("cond_var").alias("cond_var"), F.first("cond_value").alias("cond_value"), F.count(F.lit(1)).alias("n"), F.count_distinct("household_id").alias("households"),
        F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"),
    )
    se = F.col("sd") / F.sqrt(F.col("n").cast("double"))
    out = moments.join(quantiles(long, by, "v", {f"q{q}": q / 100 for q in SHARES}), by)
    return out.select(
        "fuel", "split", "cond_var", "cond_value", "n", "households", "mean", "sd", se.alias("se"), (F.col("mean") - 1.96 * se).alias("low"), (F.col("mean") + 1.96 * se).alias("high"),
        *[f"q{q}" for q in SHARES],
    )


def weekly_tokens(weeks: DataFrame, tokens: DataFrame, bins: int, means: DataFrame) -> DataFrame:
    """Metrics of the tokens of each week and, in the row of week 0, of all the real ones; deviations are from those.

    weeks: token with week, of synthetic series; tokens: token of real ones; means(token, value): the bins' means. Columns: n, sd of
    frequencies, masses of the halves, entropy, implied mean, and the differences of entropy and implied mean to week 0."""
    real = tokens.select(F.lit(0).alias("week"), "token")
    freqs = compare.token_counts(weeks.select("week", "token").unionByName(real), F.col("token"), bins, "week")
    summary = compare.token_summary(freqs, bins, "week").select("week", "n", "sd", "lower_half", "upper_half", "entropy")
    implied = freqs.join(F.broadcast(means.select("token", "value")), "token").groupBy("week").agg(F.sum(F.col("f") * F.col("value")).alias("implied_mean"))  # a row a bin
    out = summary.join(implied, "week")
    base = out.where("week = 0").select(F.col("entropy").alias("_e"), F.col("implied_mean").alias("_m"))
    out = out.join(F.broadcast(base), how="left")  # one row
    return out.withColumn("entropy_diff", F.col("entropy") - F.col("_e")).withColumn("mean_diff", F.col("implied_mean") - F.col("_m")).drop("_e", "_m")


def daily_patterns(readings: DataFrame, order: tuple[str, ...] = ("ts",), length: int = 336) -> dict[str, DataFrame]:
    """profile, patterns (peak, trough, cv by fuel and split), findings against train, weekly and degraded (first weeks that lose
    the shape of week 1)."""
    profile = stats.daily_profile(readings, "split", "fuel").where("day_type = 'all'")
    patterns = stats.pattern_metrics(profile, "split", "fuel")
    weeks = stats.week_of_series(readings, ["split", "household_id", "fuel"], list(order), length, None)
    shape = stats.weekly_shape(weeks, "split", "fuel")
    wide = stats.by_split(profile, ["fuel", "half_hour"], ["mean"])
    both = F.col("mean_synth").isNotNull() & F.col("mean_train").isNotNull()
    a, b = (F.when(both, F.col(f"mean_{x}")) for x in ("synth", "train"))
    cv = lambda x: F.try_divide(F.stddev_pop(f"mean_{x}"), F.avg(f"mean_{x}"))
    swing = lambda x: F.max(f"mean_{x}") - F.min(f"mean_{x}")
    found = wide.groupBy("fuel").agg(
        F.try_divide(cv("synth"), cv("train")).alias("cv_ratio"), F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("corr"),
        F.try_divide(swing("synth"), swing("train")).alias("amplitude"),
    )
    found = found.withColumn("findings", stats.pattern_verdict(F.col("cv_ratio"), F.col("corr"), F.col("amplitude")))
    return {"profile": profile, "patterns": patterns, "findings": found, "weekly": shape, "degraded": stats.first_degraded(shape, "split", "fuel")}


def collapse(readings: DataFrame) -> dict[str, DataFrame]:
    """seasonal means and the collapse of December against January."""
    seasonal = stats.seasonal(readings, "split", "fuel")
    return {"seasonal": seasonal, "collapse": stats.collapse(seasonal, "split", "fuel")}


def token_distribution(readings: DataFrame, edges: dict[str, list[float]] | None) -> dict[str, DataFrame]:
    """Tables of token frequencies by split, and the largest gap of synth's distribution to train's, by fuel."""
    if not edges:
        raise ValueError("bin edges are needed for the token distribution")
    from .evaluate import token_section

    tokens = token_section(readings, edges)
    gap = F.col("cdf_synth") - F.col("cdf_train")
    return {"tokens": tokens, "gaps": tokens.groupBy("fuel").agg(F.max(F.abs(gap)).alias("max_gap"), F.max_by("token", F.struct(F.abs(gap), -F.col("token"))).alias("token"))}


def suite(
    readings: DataFrame, context: list[str], edges: dict[str, list[float]] | None = None, order: tuple[str, ...] = ("ts",), length: int = 336,
    keep: Callable[[str, DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(report, tables): a row of REPORT for each table of each diagnostic, in their order; tables by "<diagnostic>.<result>".

    keep stores a table, if given (write it, say, and read it back); its rows are counted either way, so a diagnostic that can't be
    worked out fails here. It then has one row with the error, no tables, and the next one runs."""
    diagnostics: dict[str, Callable[[], dict[str, DataFrame]]] = {
        "collapse": lambda: collapse(readings), "daily_patterns": lambda: daily_patterns(readings, order, length),
        "household_month_fidelity": lambda: {"household_months": household_month_fidelity(readings, context)}, "token_distribution": lambda: token_distribution(readings, edges),
    }
    report, tables = [], {}
    for position, (name, run) in enumerate(diagnostics.items(), 1):
        try:
            made = {k: keep(f"{name}.{k}", v) if keep else v for k, v in run().items()}
            rows = [(name, position, "completed", k, v.count(), None) for k, v in made.items()]
        except Exception as e:  # recorded, and the suite goes on
            report.append((name, position, "failed", None, None, f"{type(e).__name__}: {str(e).splitlines()[0][:200]}"))
            continue
        report += rows
        tables |= {f"{name}.{k}": v for k, v in made.items()}
    return readings.sparkSession.createDataFrame(report, REPORT), tables
