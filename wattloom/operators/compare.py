"""Distribution comparison: Wasserstein, Kolmogorov-Smirnov, correlations, token distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_corr
from .ranks import running


def _weighted(a: DataFrame, b: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by..., v, F, G, next): both empirical distribution functions at each distinct value."""
    one = lambda df, x, y: df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("v"), F.lit(x).alias("a"), F.lit(y).alias("b"))
    both = one(a, 1, 0).unionByName(one(b, 0, 1)).groupBy(*by, "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    return running(both, by, "v", ["a", "b"]).select(
        *by, "v", F.try_divide("a_upto", F.col("a_all")).alias("fa"), F.try_divide("b_upto", F.col("b_all")).alias("fb"),
        F.col("v_next").alias("next"), F.col("a_all").alias("na"), F.col("b_all").alias("nb"),
    )


def distances(a: DataFrame, b: DataFrame, by: list[str] | None = None, value: str = "value") -> DataFrame:
    """Wasserstein-1 and the KS statistic of two samples by group, with sizes. Windows are over ranges of distinct values."""
    by = by or []
    gap = F.abs(F.col("fa") - F.col("fb"))
    return _weighted(a, b, by, value).groupBy(*by).agg(
        F.sum(gap * (F.col("next") - F.col("v"))).alias("wasserstein"), F.max(gap).alias("ks"), F.max("na").alias("n_a"), F.max("nb").alias("n_b")
    )


def normalised(dist: DataFrame, reference: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """distances with the Wasserstein distance over the reference's population sd."""
    sd = reference.groupBy(*by).agg(F.stddev_pop(value).alias("_sd"))
    out = dist.join(sd, by) if by else dist.crossJoin(F.broadcast(sd))
    return out.withColumn("wasserstein_norm", F.try_divide("wasserstein", F.col("_sd"))).drop("_sd")


def ks_p(d: Column, n_a: Column, n_b: Column, terms: int = 60) -> Column:
    """Asymptotic two-sided p-value by the Kolmogorov series."""
    n = F.try_divide(n_a * n_b, n_a + n_b).cast("double")
    lam = (F.sqrt(n) + 0.12 + 0.11 / F.sqrt(n)) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda s, j: s + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j * j * lam * lam))
    return F.when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def ks_status(p: Column) -> Column:
    return F.when(p.isNull(), "no_comparison_data").when(p > 0.05, "pass").when(p > 0.01, "warn").otherwise("fail")


def student_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t by the continued fraction of the incomplete beta function."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
        h = d
        for m in range(1, 300):
            for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 / (1 + k * d or 1e-300)
                c = 1 + k / c or 1e-300
                h *= c * d
        return h

    if x < (a + 1) / (a + b + 2):
        return min(1.0, front * fraction(a, b, x) / a)
    return max(0.0, 1 - front * fraction(b, a, 1 - x) / b)


# correlations


def month_correlations(df: DataFrame, pairs: list[tuple[str, str]], *by: str, least: int = 10) -> DataFrame:
    """(by..., pair, r): guarded Pearson correlation of column pairs; invalid ones are left out."""
    wide = df.groupBy(*by).agg(*[safe_corr(a, b, least).alias(f"{a}_{b}") for a, b in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("r")) for a, b in pairs]))
    return wide.select(*by, rows.alias("_r")).select(*by, "_r.pair", "_r.r").where("r IS NOT NULL")


def correlation_comparison(r: DataFrame) -> DataFrame:
    """pair, split: mean and sd of r and the difference of synth's mean to the split's, graded against train."""
    s = r.groupBy("pair", "split").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.count("r").alias("n"))
    synth = s.where("split = 'synth'").select("pair", F.col("mean").alias("synth"))
    diff = F.col("synth") - F.col("mean")
    status = F.when(F.abs(diff) >= 0.2, "fail").when(F.abs(diff) >= 0.1, "warn").otherwise("pass")
    return s.where("split <> 'synth'").join(synth, "pair").select("pair", "split", "mean", "sd", "n", diff.alias("diff"), F.when(F.col("split") == "train", status).alias("status"))


# token distributions


def token_counts(df: DataFrame, token: Column, bins: int, *by: str) -> DataFrame:
    """(by..., token, n, f): counts over all bins 0..bins-1, empty ones included; frequencies are 0 without rows."""
    counts = df.select(*by, token.alias("token")).where("token IS NOT NULL").groupBy(*by, "token").agg(F.count(F.lit(1)).alias("n"))
    keys = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = keys.withColumn("token", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = grid.join(counts, [*by, "token"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = Window.partitionBy(*(by or [F.lit(0)]))  # over bins
    return full.select(*by, "token", "n", F.coalesce(F.try_divide("n", F.sum("n").over(total)), F.lit(0.0)).alias("f"))


def with_cdf(freqs: DataFrame, *by: str) -> DataFrame:
    return freqs.withColumn("cdf", F.sum("f").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("token")))


def token_summary(freqs: DataFrame, bins: int, *by: str) -> DataFrame:
    """Entropy in bits and its maximum, sd of frequencies, deviation from uniform, mass of halves and thirds, mean token."""
    f, t = F.col("f"), F.col("token")
    mass = lambda test: F.sum(F.when(test, f).otherwise(0.0))
    return freqs.groupBy(*by).agg(
        F.sum("n").alias("n"), (-F.sum(F.when(f > 0, f * F.log2(f)).otherwise(0.0))).alias("entropy"), F.lit(math.log2(bins)).alias("max_entropy"), F.stddev_pop("f").alias("sd"),
        F.max(F.abs(f - 1 / bins)).alias("max_deviation"), mass(t < bins // 2).alias("lower_half"), mass(t >= bins // 2).alias("upper_half"),
        mass(t < bins // 3).alias("lower_third"), mass((t >= bins // 3) & (t < 2 * bins // 3)).alias("middle_third"), mass(t >= 2 * bins // 3).alias("upper_third"), F.sum(f * t).alias("mean_token"),
    )


def cdf_gap(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Largest absolute gap of two token CDFs, its sign and its token (the first on ties)."""
    j = with_cdf(a, *by).select(*by, "token", F.col("cdf").alias("x")).join(with_cdf(b, *by).select(*by, "token", F.col("cdf").alias("y")), [*by, "token"])
    gap = F.col("x") - F.col("y")
    at = F.struct(F.abs(gap), -F.col("token"))
    return j.groupBy(*by).agg(F.max(F.abs(gap)).alias("max_gap"), F.max_by(gap, at).alias("signed_gap"), F.max_by("token", at).alias("token"))


def token_table(synth: DataFrame, real: DataFrame, edges: DataFrame) -> DataFrame:
    """Per bin: lower, upper, width, centre, counts and frequencies of both sides and their difference. edges(token, lower, upper)."""
    s = synth.select("token", F.col("n").alias("n_synth"), F.col("f").alias("f_synth"))
    r = real.select("token", F.col("n").alias("n_real"), F.col("f").alias("f_real"))
    out = edges.join(s, "token", "left").join(r, "token", "left").na.fill(0)
    return out.select("token", "lower", "upper", (F.col("upper") - F.col("lower")).alias("width"), ((F.col("upper") + F.col("lower")) / 2).alias("centre"), "n_synth", "n_real", "f_synth", "f_real", (F.col("f_synth") - F.col("f_real")).alias("diff"))


def most_different(table: DataFrame, k: int = 5) -> DataFrame:
    """The k tokens most over- and under-represented."""
    over = table.orderBy(F.desc("diff"), "token").limit(k).withColumn("side", F.lit("over"))
    return over.unionByName(table.orderBy("diff", "token").limit(k).withColumn("side", F.lit("under")))


def frequency_finding(synth: DataFrame, real: DataFrame, margin: float = 0.005) -> DataFrame:
    """Half masses of both sides and a verdict: a shift counts beyond the margin. Inputs: token_summary rows."""
    j = synth.select(F.col("lower_half").alias("s"), F.col("mean_token").alias("mean_synth")).crossJoin(F.broadcast(real.select(F.col("lower_half").alias("r"), F.col("mean_token").alias("mean_real"))))
    d = F.col("s") - F.col("r")
    return j.select(d.alias("lower_half_shift"), "mean_synth", "mean_real", F.when(d > margin, "shifted to low tokens").when(d < -margin, "shifted to high tokens").otherwise("balanced").alias("finding"))


def mechanisms(train: DataFrame, weekly: DataFrame, *by: str) -> DataFrame:
    """L1 size of two effects: week 1 against train (what is learnt) and each later week against week 1 (drift).

    train(by..., token, f), weekly(by..., week, token, f)."""
    one = weekly.where("week = 1").select(*by, "token", F.col("f").alias("f1"))
    base = train.select(*by, "token", F.col("f").alias("ft"))
    j = weekly.where("week > 1").join(one, [*by, "token"]).join(base, [*by, "token"])
    out = j.groupBy(*by, "week").agg(F.sum(F.abs(F.col("f1") - F.col("ft"))).alias("learning"), F.sum(F.abs(F.col("f") - F.col("f1"))).alias("drift"))
    return out.withColumn("drift_pct", 100 * F.try_divide("drift", F.col("drift") + F.col("learning")))


def value_statistics(df: DataFrame, *by: str, value: str = "value") -> DataFrame:
    """Mean, median, sd, p10, p25, p75, p90, p99, population skewness, mean / median and share of zeros."""
    q = F.percentile(value, F.array(*[F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9, 0.99)]))
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.skewness(value).alias("skew"), F.try_divide(F.count_if(F.col(value) == 0), F.count(value)).alias("zero_rate"), q.alias("q"))
    return out.select(*by, "n", "mean", "sd", "skew", "zero_rate", *[F.col("q")[i].alias(x) for i, x in enumerate(("p10", "p25", "median", "p75", "p90", "p99"))], F.try_divide("mean", F.nullif(F.col("q")[2], F.lit(0.0))).alias("mean_to_median"))


def median_bias(synth: DataFrame, real: DataFrame) -> DataFrame:
    """Whether synth's mean is nearer to the real median than to the real mean, and its bias in percent. value_statistics rows."""
    j = synth.select(F.col("mean").alias("synth_mean")).crossJoin(F.broadcast(real.select(F.col("mean").alias("real_mean"), F.col("median").alias("real_median"))))
    return j.select("*", (F.abs(F.col("synth_mean") - F.col("real_median")) < F.abs(F.col("synth_mean") - F.col("real_mean"))).alias("median_biased"), (100 * F.try_divide(F.col("synth_mean") - F.col("real_mean"), F.col("real_mean"))).alias("bias_pct"))


def below_range(df: DataFrame, low: float, *by: str, value: str = "value") -> DataFrame:
    """Share of values under the first edge; reported when above 1 %."""
    share = F.avg((F.col(value) < low).cast("int"))
    return df.groupBy(*by).agg(share.alias("share"), (share > 0.01).alias("reported"))
