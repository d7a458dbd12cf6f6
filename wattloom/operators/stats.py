"""Summaries: marginal, conditional, missingness, runs, profiles, seasons, autocorrelation, volatility, temperature response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (5, 10, 25, 50, 75, 90, 95)


def fuel_stats(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """n, sum, mean, population variance and sd, min, max and seven linear quantiles of the values that are there."""
    q = F.percentile(value, F.array(*[F.lit(x / 100) for x in QUANTILES]))
    out = df.groupBy(*by).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"), F.stddev_pop(value).alias("sd"),
        F.min(value).alias("least"), F.max(value).alias("most"), q.alias("_q"),
    )
    return out.select(*by, "n", "total", "mean", "var", "sd", "least", "most", *[F.col("_q")[i].alias(f"p{x}") for i, x in enumerate(QUANTILES)])


def combined(stats: DataFrame, *by: str) -> DataFrame:
    """Merges partial fuel_stats: moments exactly, quantiles as means weighted by n (an approximation, kept for parity)."""
    w = lambda c: F.try_divide(F.sum(F.col(c) * F.col("n")), F.sum("n"))
    second = F.try_divide(F.sum((F.col("var") + F.col("mean") * F.col("mean")) * F.col("n")), F.sum("n"))
    return stats.groupBy(*by).agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), w("mean").alias("mean"), F.greatest(second - F.pow(w("mean"), 2), F.lit(0.0)).alias("var"),
        F.min("least").alias("least"), F.max("most").alias("most"), *[w(f"p{x}").alias(f"p{x}") for x in QUANTILES],
    )


def monthly_sums(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    return df.groupBy(*by, "month").agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def ratio_status(r: Column, ok: tuple[float, float] = (0.8, 1.2), warn: tuple[float, float] = (0.5, 2.0)) -> Column:
    return F.when(r.isNull(), "no_comparison_data").when(r.between(*ok), "pass").when(r.between(*warn), "warn").otherwise("fail")


def by_split(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One row a key with <value>_<split> columns."""
    splits = ("synth", "train", "val", "test")
    return df.groupBy(*keys).agg(*[F.max(F.when(F.col("split") == s, F.col(v))).alias(f"{v}_{s}") for v in values for s in splits])


def marginal_comparison(df: DataFrame, *keys: str) -> DataFrame:
    """Per fuel: mean and sd ratios synth / train, mean relative error of the quantiles, status."""
    names = ["mean", "sd", *[f"p{x}" for x in QUANTILES]]
    wide = by_split(fuel_stats(df, *keys, "split"), list(keys), names)
    errors = F.array_compact(F.array(*[F.abs(F.try_divide(F.col(f"p{x}_synth") - F.col(f"p{x}_train"), F.nullif(F.col(f"p{x}_train"), F.lit(0.0)))) for x in QUANTILES]))
    mae = F.try_divide(F.aggregate(errors, F.lit(0.0), lambda a, x: a + x), F.size(errors))
    mean, sd = (F.try_divide(F.col(f"{v}_synth"), F.col(f"{v}_train")) for v in ("mean", "sd"))
    return wide.select(*keys, mean.alias("mean_ratio"), sd.alias("sd_ratio"), mae.alias("quantile_mae"), ratio_status(mean).alias("status"))


def unpivot_context(df: DataFrame, variables: list[str], keep: list[str]) -> DataFrame:
    """A row for each conditioning variable: cond_var, cond_value."""
    rows = F.explode(F.array(*[F.struct(F.lit(v).alias("cond_var"), F.col(v).cast("string").alias("cond_value")) for v in variables]))
    return df.select(*keep, rows.alias("_c")).select(*keep, "_c.cond_var", "_c.cond_value").where("cond_value IS NOT NULL")


def conditional(df: DataFrame, variables: list[str], *keys: str, value: str = "value") -> DataFrame:
    """fuel_stats moments and distinct households by each variable's values."""
    long = unpivot_context(df, variables, [*keys, "household_id", value])
    return long.groupBy("cond_var", "cond_value", *keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count_distinct("household_id").alias("households")
    )


def group_means(df: DataFrame, variable: str, *keys: str, value: str = "value") -> DataFrame:
    return df.groupBy(*keys, variable).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))


def with_ci(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """n, mean, median, sample sd (0 for one value), standard error and mean +- 1.96 of it."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    se = F.try_divide("sd", F.sqrt(F.col("n").cast("double")))
    return out.select("*", se.alias("se"), (F.col("mean") - 1.96 * se).alias("low"), (F.col("mean") + 1.96 * se).alias("high"))


def distribution(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("q"))
    return out.select(*by, "n", "mean", "sd", "least", "most", *[F.col("q")[i].alias(x) for i, x in enumerate(("p5", "p25", "median", "p75", "p95"))])


def quintiles(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.2, 0.4, 0.6, 0.8)]))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), q.alias("q"))
    return out.select(*by, "n", "mean", "sd", "least", "most", *[F.col("q")[i].alias(f"q{20 * (i + 1)}") for i in range(4)])


def distribution_shift(all_rows: DataFrame, kept: DataFrame, value: str = "value", warn_pct: float = 5.0) -> DataFrame:
    """Kept less all for mean, median and sd; warn beyond warn_pct of the mean."""
    a, b = (distribution(x, value=value).select(*[F.col(c).alias(f"{c}_{s}") for c in ("n", "mean", "median", "sd")]) for x, s in ((all_rows, "all"), (kept, "kept")))
    pct = 100 * F.try_divide(F.col("mean_kept") - F.col("mean_all"), F.col("mean_all"))
    return a.crossJoin(F.broadcast(b)).select(
        "n_all", "n_kept", *[(F.col(f"{c}_kept") - F.col(f"{c}_all")).alias(f"{c}_shift") for c in ("mean", "median", "sd")], pct.alias("mean_shift_pct"), (F.abs(pct) > warn_pct).alias("warn")
    )


def household_months(df: DataFrame, *extra: str, value: str = "value") -> DataFrame:
    return df.groupBy("household_id", "month", "fuel", *extra).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def household_groups(df: DataFrame, variables: list[str], *by: str, value: str = "value") -> DataFrame:
    """Household-month means by split and by each variable's values (cond_var "all" for everyone): households, months, mean, sd."""
    months = df.groupBy(*by, "household_id", "month", *variables).agg(F.avg(value).alias("m")).where("m IS NOT NULL")
    long = unpivot_context(months.withColumn("all", F.lit("all")), ["all", *variables], [*by, "household_id", "m"])
    return long.groupBy("cond_var", "cond_value", *by).agg(
        F.count_distinct("household_id").alias("households"), F.count(F.lit(1)).alias("household_months"), F.avg("m").alias("mean"), F.stddev_pop("m").alias("sd")
    )


def households(df: DataFrame, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct("household_id").alias("households"))


def missing_stats(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Percent missing and zero (of all rows) and percent of households without any value."""
    home = df.groupBy("household_id", *[b for b in by if b != "household_id"]).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("k"), F.count_if(F.col(value) == 0).alias("z"))
    return home.groupBy(*by).agg(
        F.sum("n").alias("n"), (100 * F.try_divide(F.sum(F.col("n") - F.col("k")), F.sum("n"))).alias("missing_pct"), (100 * F.try_divide(F.sum("z"), F.sum("n"))).alias("zero_pct"),
        (100 * F.try_divide(F.count_if(F.col("k") == 0), F.count(F.lit(1)))).alias("empty_pct"),
    )


def runs(df: DataFrame, test: Column, keys: list[str], order: list[str]) -> DataFrame:
    """(keys..., length): a row for each maximal run of rows that meet the test."""
    w = Window.partitionBy(*keys).orderBy(*order)
    mark = F.coalesce(test, F.lit(False))
    islands = df.select(*keys, *order, mark.alias("_m")).withColumn("_g", F.row_number().over(w) - F.sum(F.col("_m").cast("int")).over(w))
    return islands.where("_m").groupBy(*keys, "_g").agg(F.count(F.lit(1)).alias("length")).drop("_g")


def run_histogram(run_rows: DataFrame, *by: str) -> DataFrame:
    return run_rows.groupBy(*by, "length").agg(F.count(F.lit(1)).alias("runs"))


def run_summary(hist: DataFrame, *by: str) -> DataFrame:
    return hist.groupBy(*by).agg(F.max("length").alias("longest"), F.try_divide(F.sum(F.col("length") * F.col("runs")), F.sum("runs")).alias("mean_length"), F.sum("runs").alias("runs"))


# calendar profiles


def daily_profile(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """n, mean, sd and standard error by half-hour for all days, weekdays and weekends."""
    kinds = F.array(F.lit("all"), F.when(F.col("dow") >= 5, "weekend").otherwise("weekday"))
    rows = df.select(*by, "half_hour", value, F.explode(kinds).alias("day_type"))
    return rows.groupBy(*by, "day_type", "half_hour").agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.median(value).alias("median"),
        F.when(F.count(value) > 1, F.stddev_pop(value) / F.sqrt(F.count(value).cast("double"))).otherwise(0.0).alias("se"),
    )


def monthly_profile(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    se = F.when(F.count(value) > 1, F.stddev_pop(value) / F.sqrt(F.count(value).cast("double"))).otherwise(0.0)
    return df.groupBy(*by, "month", "half_hour").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), se.alias("se"))


def profile_rmse(a: DataFrame, b: DataFrame, keys: list[str], at: str = "half_hour", least: int = 1) -> DataFrame:
    """Root mean squared difference of two profiles over the points both have; null under `least` points."""
    both = a.select(*keys, at, F.col("mean").alias("x")).join(b.select(*keys, at, F.col("mean").alias("y")), [*keys, at]).where("x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= least, F.sqrt(F.avg(F.pow(F.col("x") - F.col("y"), 2)))).alias("rmse"), F.count(F.lit(1)).alias("points"))


def week_of_series(df: DataFrame, keys: list[str], order: list[str], length: int = 336, weeks: int | None = 4) -> DataFrame:
    """df with week = position // length + 1 within keys; rows after the last week are left out."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("week", (F.floor((F.row_number().over(w) - 1) / length) + 1).cast("int"))
    return out if weeks is None else out.where(F.col("week") <= weeks)


def weekly_fidelity(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Mean, sd, se and quantiles of each week, and the ratio of its mean to that of week 1."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9)]))
    s = df.groupBy(*by, "week").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), q.alias("q"))
    first = s.where("week = 1").select(*by, F.col("mean").alias("_m1"))
    out = s.join(first, list(by), "left") if by else s.crossJoin(F.broadcast(first))
    return out.select(
        *by, "week", "n", "mean", "sd", F.try_divide("sd", F.sqrt(F.col("n").cast("double"))).alias("se"), *[F.col("q")[i].alias(x) for i, x in enumerate(("p10", "p25", "p50", "p75", "p90"))],
        F.try_divide("mean", F.col("_m1")).alias("to_week1"),
    )


def weekly_shape(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Per week over its half-hour means: cv, peak/trough (null if the trough is not positive), correlation with week 1."""
    p = df.groupBy(*by, "week", "half_hour").agg(F.avg(value).alias("m"))
    one = p.where("week = 1").select(*by, "half_hour", F.col("m").alias("m1"))
    j = p.join(one, [*by, "half_hour"], "left")
    both = F.col("m").isNotNull() & F.col("m1").isNotNull()
    corr = F.when(F.count_if(both) > 2, F.try_divide(F.covar_pop("m", "m1"), F.stddev_pop(F.when(both, F.col("m"))) * F.stddev_pop(F.when(both, F.col("m1")))))
    return j.groupBy(*by, "week").agg(
        F.count("m").alias("points"), F.avg("m").alias("mean"), F.try_divide(F.stddev_pop("m"), F.avg("m")).alias("cv"), F.when(F.min("m") > 0, F.max("m") / F.min("m")).alias("peak_trough"), corr.alias("corr_week1")
    )


def first_degraded(shape: DataFrame, *by: str) -> DataFrame:
    """First week with correlation under 0.7, and first whose cv is under half of week 1's."""
    one = shape.where("week = 1").select(*by, F.col("cv").alias("cv1"))
    j = shape.join(one, list(by)) if by else shape.crossJoin(F.broadcast(one))
    return j.groupBy(*by).agg(F.min(F.when(F.col("corr_week1") < 0.7, F.col("week"))).alias("corr_week"), F.min(F.when(F.try_divide("cv", F.col("cv1")) < 0.5, F.col("week"))).alias("cv_week"))


def pattern_metrics(profile: DataFrame, *by: str) -> DataFrame:
    """Peak and trough with their half-hours (first on ties), ratio and cv of a profile."""
    first = lambda sign: F.max_by("half_hour", F.struct(sign * F.col("mean"), -F.col("half_hour")))
    return profile.groupBy(*by).agg(
        F.max("mean").alias("peak"), first(1).alias("peak_half_hour"), F.min("mean").alias("trough"), first(-1).alias("trough_half_hour"),
        F.when(F.min("mean") > 0, F.max("mean") / F.min("mean")).alias("peak_trough"), F.try_divide(F.stddev_pop("mean"), F.avg("mean")).alias("cv"),
    )


def pattern_verdict(cv_ratio: Column, corr: Column, amplitude: Column) -> Column:
    """Findings of a daily pattern against the real one, joined by "; "."""
    return F.concat_ws("; ", F.when(cv_ratio < 0.5, "flat"), F.when(corr < 0.5, "shape mismatch"), F.when(amplitude < 0.7, "reduced amplitude"))


def heatmap(profile: DataFrame, *by: str, slots: int = 48) -> DataFrame:
    """month x half-hour matrix of means."""
    return profile.groupBy(*by, "month").pivot("half_hour", list(range(1, slots + 1))).agg(F.first("mean"))


def on_grid(df: DataFrame, keys: DataFrame, **axes: tuple[int, int]) -> DataFrame:
    """df completed to every key and every value of the axes (inclusive ranges); what is absent is null."""
    grid = keys.distinct()
    for name, (low, high) in axes.items():
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(low), F.lit(high))))
    return grid.join(df, [*keys.columns, *axes], "left")


def seasonal(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """with_ci over household means by month."""
    homes = df.groupBy(*by, "household_id", "month").agg(F.avg(value).alias("value")).where("value IS NOT NULL")
    return with_ci(homes, *by, "month")


def collapse(monthly: DataFrame, *by: str) -> DataFrame:
    """December mean over January mean and its band."""
    r = F.try_divide(F.max(F.when(F.col("month") == 12, F.col("mean"))), F.max(F.when(F.col("month") == 1, F.col("mean"))))
    out = monthly.groupBy(*by).agg(r.alias("collapse_ratio"))
    c = F.col("collapse_ratio")
    return out.withColumn("band", F.when(c.isNull(), "unknown").when(c < 0.5, "severe").when(c < 0.8, "moderate").when(c < 1.2, "stable").otherwise("growth"))


# sequences


def differences(df: DataFrame, keys: list[str], order: list[str], value: str = "value") -> DataFrame:
    """diff: the value less the previous non-null value of its series."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.where(F.col(value).isNotNull())
    return out.withColumn("diff", F.col(value) - F.lag(value).over(w)).where("diff IS NOT NULL")


def rolling_sd(df: DataFrame, keys: list[str], order: list[str], window: int, value: str = "value") -> DataFrame:
    """vol: sample sd of the last `window` non-null values, full windows only."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.where(F.col(value).isNotNull()).withColumns({"vol": F.stddev_samp(value).over(w.rowsBetween(1 - window, 0)), "_n": F.row_number().over(w)})
    return out.where(F.col("_n") >= window).drop("_n")


def autocorrelation(df: DataFrame, keys: list[str], order: list[str], lags: list[int], value: str = "value") -> DataFrame:
    """(keys..., lag, acf) on null-compressed positions, for series longer than the largest lag + 1; null if constant."""
    w = Window.partitionBy(*keys).orderBy(*order)
    base = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("x"), *[F.lag(value, k).over(w).cast("double").alias(f"l{k}") for k in lags], F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_n"))
    base = base.where(F.col("_n") > max(lags) + 1)

    def acf(k: int) -> Column:
        x, y = F.when(F.col(f"l{k}").isNotNull(), F.col("x")), F.col(f"l{k}")
        return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))

    out = base.groupBy(*keys).agg(*[acf(k).alias(f"a{k}") for k in lags])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"a{k}").alias("acf")) for k in lags]))
    return out.select(*keys, rows.alias("_r")).select(*keys, "_r.lag", "_r.acf")


def acf_summary(acf: DataFrame, *by: str) -> DataFrame:
    return acf.where("acf IS NOT NULL").groupBy(*by, "lag").agg(F.avg("acf").alias("mean"), F.stddev_pop("acf").alias("sd"), F.count("acf").alias("n"))


def diff_quantiles(diffs: DataFrame, *by: str, value: str = "diff") -> DataFrame:
    """p50, p75, p90, p95 of absolute differences, their sd and excess kurtosis about the sample sd (null under 4)."""
    n = F.count(value).cast("double")
    q = F.percentile(F.abs(value), F.array(*[F.lit(x) for x in (0.5, 0.75, 0.9, 0.95)]))
    kurt = F.when(n >= 4, (F.kurtosis(value) + 3) * F.pow((n - 1) / n, 2) - 3)
    out = diffs.groupBy(*by).agg(F.count(value).alias("n"), F.stddev_pop(value).alias("sd"), kurt.alias("excess_kurtosis"), q.alias("q"))
    return out.select(*by, "n", "sd", "excess_kurtosis", *[F.col("q")[i].alias(x) for i, x in enumerate(("p50", "p75", "p90", "p95"))])


# temperature response


def ptg(df: DataFrame, *by: str, value: str = "value", temp: str = "temp_c") -> DataFrame:
    """Mean consumption and temperature by month, where both have values."""
    out = df.groupBy(*by, "month").agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.sum(temp).alias("ts"), F.count(temp).alias("tn"))
    return out.where("n > 0 AND tn > 0").select(*by, "month", (F.col("s") / F.col("n")).alias("consumption"), (F.col("ts") / F.col("tn")).alias("temperature"))


def ptg_slope(monthly: DataFrame, *by: str, least: int = 3) -> DataFrame:
    x, y = "temperature", "consumption"
    slope = F.try_divide(F.covar_pop(x, y), F.var_pop(x))
    return monthly.groupBy(*by).agg(F.when(F.count(F.lit(1)) >= least, slope).alias("slope"), F.count(F.lit(1)).alias("months"))


def ptg_lines(monthly: DataFrame, breakpoint: float, *by: str) -> DataFrame:
    """One least-squares line at or below the breakpoint and one above, from 2 points each."""
    side = F.when(F.col("temperature") <= breakpoint, "heating").otherwise("base")
    slope = F.try_divide(F.covar_pop("temperature", "consumption"), F.var_pop("temperature"))
    out = monthly.withColumn("side", side).groupBy(*by, "side").agg(F.count(F.lit(1)).alias("months"), slope.alias("slope"), (F.avg("consumption") - slope * F.avg("temperature")).alias("intercept"))
    return out.where("months >= 2")
