"""End-to-end plans: tokenise, prepare splits, evaluate synthetic against real."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from ..operators import compare, features, filters, grade, pairs, privacy, splits, stats, vocab
from ..operators.shared import series_table


def tokenise(readings: DataFrame, catalog: DataFrame, exporters: DataFrame, bins: dict[str, int], limit: float = 0.2, **options) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, readings with token) of the households that are no exporters and complete."""
    kept = filters.attach_missingness(filters.without_exporters(catalog, exporters), readings, tuple(bins)).where(filters.complete(tuple(bins), limit))
    own = readings.join(kept.select("household_id"), "household_id", "left_semi")
    table = vocab.build(own, bins, "fuel", "value", **options)
    v = F.broadcast(table.select(F.col("modality").alias("fuel"), "boundaries", "zero_aware", "value_transform"))  # a row a fuel
    transform = options.get("transform", "none")
    token = F.when(F.col("zero_aware"), vocab.encode(F.col("value"), F.col("boundaries"), True, transform)).otherwise(vocab.encode(F.col("value"), F.col("boundaries"), False, transform))
    out = own.join(v, "fuel").withColumn("token", token).drop("boundaries", "zero_aware", "value_transform")
    return table, vocab.calendar_tokens(out)


def prepare(catalog: DataFrame, variables: list[str], k: int, val: int, test: int, shards: int, size: int, limit: float = 0.2, seed: int = 42) -> dict[str, DataFrame]:
    """Filtered catalog, stage report, split assignment with shards, dictionary of the variables."""
    kept, report = filters.filter_households(catalog, variables, k, limit)
    assigned = splits.assign_splits(kept, val, test, seed)
    use = assigned.where("split = 'train'").withColumn("use", F.col("electricity_mean") + F.coalesce("gas_mean", F.lit(0.0)))
    placed = splits.training_shards(splits.energy_tiers(use), shards, size, seed=seed)
    out = assigned.select("household_id", "split").join(placed.select("household_id", "shard"), "household_id", "left")
    dictionary = None
    for v in variables:
        d = vocab.categories(kept, v)
        dictionary = d if dictionary is None else dictionary.unionByName(d)
    return {"catalog": kept, "report": report, "assignment": out, "dictionary": dictionary}


def evaluate(
    readings: DataFrame, context: list[str], lags: tuple[int, ...] = (1, 2, 4), exclusions: DataFrame | None = None, order: tuple[str, ...] = ("ts",),
    edges: dict[str, list[float]] | None = None, temp: str | None = None, batches: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Report sections of readings with split: lazy DataFrames by name. Without real splits, comparisons are null.

    Readings are stored once as a table bucketed by household, from which all sections of series come without a shuffle of theirs.
    edges: bin edges by fuel for the token section. temp: a column of temperatures, for the sections ptg and correlations.
    batches(batch_id, household_id, step, fuel, value): synthetic batches, for the section variance."""
    sections: dict[str, DataFrame] = {}
    if exclusions is not None:
        readings, sections["prefilter"] = privacy.prefilter(readings, exclusions)
    readings = series_table(readings, order=order)
    series = ["split", "household_id", "month", "fuel"]
    sections["totals"] = readings.groupBy("split").agg(F.count_distinct("household_id").alias("households"), F.count_distinct("month").alias("months"))
    sections["marginal"] = stats.marginal_comparison(readings, "fuel")
    sections["marginal_counts"] = stats.fuel_stats(readings, "split", "fuel").select("split", "fuel", "n", "mean", "sd")
    sections["household_months"] = stats.household_groups(readings, context, "split", "fuel")
    if context:
        sections["conditional"] = stats.conditional(readings, context, "split", "fuel")
    profile = stats.daily_profile(readings, "split", "fuel")
    sections["profiles"] = stats.by_split(profile, ["fuel", "day_type", "half_hour"], ["mean", "n"])
    sections["monthly_profiles"] = stats.monthly_profile(readings, "split", "fuel")
    sections["seasonal"] = stats.seasonal(readings, "split", "fuel")
    sections["collapse"] = stats.collapse(sections["seasonal"], "split", "fuel")
    weeks = stats.week_of_series(readings, series, list(order))
    sections["weekly"] = stats.weekly_fidelity(weeks, "split", "fuel").join(stats.households(weeks, "split", "fuel", "week"), ["split", "fuel", "week"])
    sections["weekly_shape"] = stats.weekly_shape(weeks, "split", "fuel")
    sections["acf"] = stats.acf_summary(stats.autocorrelation(readings, series, list(order), list(lags)), "split", "fuel")
    sections["volatility"] = stats.diff_quantiles(stats.differences(readings, series, list(order)), "split", "fuel")
    sections["missingness"] = stats.missing_stats(readings, "split", "fuel")
    sections["runs"] = stats.run_histogram(stats.runs(readings, F.col("value").isNull(), series, list(order)), "split", "fuel")
    synth = readings.where("split = 'synth'")
    sections["distances"] = compare.distances(synth, readings.where("split = 'train'"), ["fuel"])
    sections["distances"] = compare.normalised(sections["distances"], readings.where("split = 'train'"), ["fuel"])
    if edges:
        sections["tokens"] = token_section(readings, edges)
    if temp:
        sections["ptg"] = stats.ptg(readings, "split", "fuel", temp=temp)
        r = readings.groupBy("split", "household_id", "fuel").agg(safe_corr("value", temp).alias("r"))
        sections["correlations"] = r.groupBy("split", "fuel").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.count("r").alias("n"))
    if batches is not None:
        sections["variance"] = batch_variance(batches)
    sections["features"] = features.household_month_features(readings, series, list(order))
    sections["flags"] = flags(sections)
    sections["verdict"] = grade.verdict(sections["flags"])
    return sections


def flags(s: dict[str, DataFrame]) -> DataFrame:
    """All fidelity flags that the sections allow."""
    name = lambda suffix: F.concat("fuel", F.lit(suffix))
    wide = lambda df, keys, values: stats.by_split(df, keys, values)
    out = [
        grade.flags_from(wide(s["volatility"], ["fuel"], ["sd", "p90"]), name("_volatility_std"), "sd"),
        grade.flags_from(wide(s["volatility"], ["fuel"], ["sd", "p90"]), name("_volatility_p90"), "p90"),
        grade.flags_from(wide(s["missingness"], ["fuel"], ["missing_pct", "zero_pct"]), name("_missing_pct"), "missing_pct", "diff"),
        grade.flags_from(wide(s["missingness"], ["fuel"], ["missing_pct", "zero_pct"]), name("_zero_pct"), "zero_pct", "diff"),
        grade.worst_flag(wide(s["acf"], ["fuel", "lag"], ["mean"]), ["fuel"], name("_acf_max_diff"), "mean", kind="diff"),
        grade.rmse_flag(s["profiles"].where("day_type = 'all'"), name("_profile_rmse")),
        grade.rmse_flag(wide(s["seasonal"], ["fuel", "month"], ["mean"]), name("_seasonal_rmse"), least=3),
    ]
    moments = s["features"].groupBy("fuel", "split").agg(F.avg("mean").alias("mean"), F.avg("std").alias("std"))
    out += [grade.flags_from(wide(moments, ["fuel"], [m]), name(f"_{m}_ratio"), m) for m in ("mean", "std")]
    if "ptg" in s:
        slopes = wide(stats.ptg_slope(s["ptg"], "split", "fuel"), ["fuel"], ["slope"]).where("abs(slope_train) >= 1e-6 and slope_synth is not null")
        out.append(grade.flags_from(slopes, name("_ptg_slope_diff"), "slope", "relative"))
        r = wide(s["correlations"], ["fuel"], ["mean"]).where("mean_synth is not null and mean_train is not null")
        out.append(grade.flags_from(r, name("_temp_correlation_diff"), "mean", "diff"))
    if "variance" in s:  # a fixed test, without natural variation
        report, none = features.variance_report(s["variance"]), F.lit(None).cast("double")
        flagged = (F.col("medium") + F.col("high")).cast("double")
        out.append(report.select(
            F.lit("within_batch_variance").alias("metric"), "status", flagged.alias("value"), flagged.alias("deviation"),
            *[none.alias(c) for c in ("train_val", "train_test", "val_test", "natural_variation")],
        ))
    if "conditional" in s:
        cond = wide(s["conditional"], ["cond_var", "cond_value", "fuel"], ["mean", "n"])
        out.append(grade.worst_flag(cond, ["fuel"], name("_conditional_mean_ratio"), "mean", "n"))
    return grade.all_flags(*out)


def batch_variance(batches: DataFrame) -> DataFrame:
    """A row a batch: tests of its pairs by fuel, number of flags and severity."""
    fuels = [r["fuel"] for r in batches.select("fuel").distinct().orderBy("fuel").collect()]  # a few
    out = batches.select("batch_id").distinct()
    for f in fuels:
        own = batches.where(F.col("fuel") == f)
        tests = [t(own, ["batch_id"]) for t in (pairs.batch_correlations, pairs.batch_distances, features.peak_diversity)]
        part = reduce(lambda a, b: a.join(b, "batch_id", "full"), tests)
        names = ("high_pairs", "mean_corr", "near_identical", "concentration")
        out = out.join(part.select("batch_id", *[F.col(n).alias(f"{f}_{n}") for n in names]), "batch_id", "left")
    return features.overfitting(out, tuple(fuels))


def token_section(readings: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """(fuel, token, n_<split>, f_<split>, cdf_<split>) of values put into bins between edges."""
    out = None
    for fuel, cuts in edges.items():
        own = readings.where((F.col("fuel") == fuel) & F.col("value").isNotNull())
        token = F.size(F.filter(F.lit(cuts[1:-1]), lambda c: c <= F.col("value")))
        freqs = compare.with_cdf(compare.token_counts(own, token, len(cuts) - 1, "split"), "split")
        part = stats.by_split(freqs.withColumn("fuel", F.lit(fuel)), ["fuel", "token"], ["n", "f", "cdf"])
        out = part if out is None else out.unionByName(part)
    return out


def sanitised(s: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The sections after disclosure control, by section:

    totals, marginal_counts, seasonal, weekly: counts of real splits are rounded. conditional: a group is suppressed if train
    or test or val has a small number of households. household_months: likewise across all splits, and rounded. tokens: bins
    that train has fewer than ten of lose all real values. profiles, monthly_profiles: their counts of values are dropped.
    features, runs and variance are about single households or batches and are left out. The others hold no counts of households, or only of
    synthetic ones, and stay. The input is not changed."""
    out = {k: v for k, v in s.items() if k not in ("features", "runs", "variance")}
    for k, counts in (("totals", ["households"]), ("marginal_counts", ["n"]), ("seasonal", ["n"]), ("weekly", ["n", "households"])):
        out[k] = privacy.real_rounded(out[k], counts)
    if "conditional" in out:
        out["conditional"] = privacy.groups_suppressed(out["conditional"].drop("n"), ["cond_var", "cond_value"], "households", ["mean", "sd"])
    out["household_months"] = privacy.groups_suppressed(out["household_months"].drop("household_months"), ["cond_var", "cond_value", "fuel"], "households", ["mean", "sd"])
    if "tokens" in out:
        out["tokens"] = privacy.tokens_suppressed(out["tokens"], privacy.REAL)
    for k in ("acf", "volatility", "missingness"):
        out[k] = privacy.real_rounded(out[k], ["n"])
    for k in ("profiles", "monthly_profiles"):
        out[k] = out[k].drop(*[c for c in out[k].columns if c == "n" or c.startswith("n_")])
    return out
