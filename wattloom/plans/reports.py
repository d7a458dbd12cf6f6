"""Queries of a whole evaluation: flags, verdict, companion extracts and diagnostics, with their SQL. Imported by queries.py."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, stats
from ..sources.readers import context_tuples, table
from . import diagnostics, evaluate, extracts, synthesis
from .queries import _DAYS, _STATUS_NV, E, EVENTS, H, HOMES, _day_tokens, _Q7, _rank, add

ORDER = ("ts", "event_id")
SERIES = ["split", "household_id", "month", "fuel"]
_TEN = "(round_even({0} / 10.0, 0) * 10)::BIGINT"
_REAL = ("train", "val", "test")


def _readings(s: SparkSession, d: str) -> DataFrame:
    """Events of one January as readings: ten days stand for a month, a number made of the event's for a temperature."""
    home = H(s, d).select("household_id", "segment", "region")
    out = E(s, d).withColumn("month", F.floor((F.dayofmonth("ts") - 1) / 10).cast("int")).withColumn("temp_c", (F.col("event_id") * 37 % 400) / 10.0)
    return out.join(home, "household_id", "left")


def _batches(s: SparkSession, d: str) -> DataFrame:
    return E(s, d).where("split = 'synth' and fuel in ('click', 'view')").groupBy("batch_id", "household_id", F.col("dow").alias("step"), "fuel").agg(F.avg("value").alias("value"))


def sections(s: SparkSession, d: str, variance: bool = False) -> dict[str, DataFrame]:
    batches = _batches(s, d) if variance else None
    return evaluate.evaluate(_readings(s, d), ["segment", "region"], lags=(1, 2), order=ORDER, temp="temp_c", batches=batches)


_E = f"""{EVENTS}, {HOMES}, e AS (SELECT r.household_id, r.split, r.fuel, r.value, r.ts, r.event_id, r.dow, r.half_hour, r.batch_id, CAST((day(ts) - 1) // 10 AS INTEGER) AS month,
  (event_id * 37 % 400) / 10.0 AS temp_c, segment, h.region FROM readings r LEFT JOIN homes h USING (household_id))"""


def _wide(source: str, keys: str, values: str) -> str:
    cols = ", ".join(f"max(CASE WHEN split = '{x}' THEN {v} END) AS {v}_{x}" for v in values.split() for x in ("synth", "train", "val", "test"))
    return f"(SELECT {keys}, {cols} FROM {source} GROUP BY {keys})"


_FAR = {
    "ratio": lambda a, b, t: f"CASE WHEN abs({b}) >= 1e-10 THEN abs({a} / {b} - 1) END", "diff": lambda a, b, t: f"abs({a} - {b})",
    "relative": lambda a, b, t: f"abs({a} - {b}) / nullif(abs({t}), 0)",
}


def _flag(source: str, metric: str, value: str, kind: str = "ratio", where: str = "true") -> str:
    """Rows (metric, value, deviation, three references) from <value>_<split> columns."""
    s, t, v, x = (f"{value}_{n}" for n in ("synth", "train", "val", "test"))
    far = lambda a, b: _FAR[kind](a, b, t)
    shown = f"{s} / nullif({t}, 0)" if kind == "ratio" else f"{s} - {t}"
    return f"SELECT {metric} AS metric, {shown} AS value, {far(s, t)} AS deviation, {far(t, v)} AS train_val, {far(t, x)} AS train_test, {far(v, x)} AS val_test FROM {source} WHERE {where}"


def _worst(flag: str) -> str:
    return f"SELECT metric, arg_max(value, deviation) AS value, max(deviation) AS deviation, max(train_val) AS train_val, max(train_test) AS train_test, max(val_test) AS val_test FROM ({flag}) GROUP BY metric"


def _rmse(source: str, metric: str, least: int) -> str:
    r = lambda a, b: f"CASE WHEN count(mean_{a} - mean_{b}) >= {least} THEN sqrt(avg(pow(mean_{a} - mean_{b}, 2))) END"
    return f"SELECT {metric} AS metric, {r('synth', 'train')} AS value, {r('synth', 'train')} AS deviation, {r('train', 'val')} AS train_val, {r('train', 'test')} AS train_test, {r('val', 'test')} AS val_test FROM {source} GROUP BY fuel"


_DIFF = "df AS (SELECT *, value - lag(value) OVER (PARTITION BY split, household_id, month, fuel ORDER BY ts, event_id) AS diff FROM e WHERE value IS NOT NULL), dn AS (SELECT * FROM df WHERE diff IS NOT NULL)"
_VOL = "vol AS (SELECT split, fuel, stddev_pop(diff) AS sd, quantile_cont(abs(diff), 0.5) AS p50, quantile_cont(abs(diff), 0.75) AS p75, quantile_cont(abs(diff), 0.9) AS p90 FROM dn GROUP BY 1, 2)"
_ACF = """l AS (SELECT *, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2, count(*) OVER (PARTITION BY split, household_id, month, fuel) AS n FROM e WHERE value IS NOT NULL WINDOW w AS (PARTITION BY split, household_id, month, fuel ORDER BY ts, event_id)),
 la AS (SELECT split, fuel, k AS lag, household_id, month, covar_pop(CASE WHEN y IS NOT NULL THEN value END, y) / nullif(stddev_pop(CASE WHEN y IS NOT NULL THEN value END) * stddev_pop(y), 0) AS a FROM
  (SELECT *, 1 AS k, l1 AS y FROM l WHERE n > 3 UNION ALL SELECT *, 2, l2 FROM l WHERE n > 3) GROUP BY ALL),
 acf AS (SELECT split, fuel, lag, avg(a) AS mean, stddev_pop(a) AS sd, count(a) AS n FROM la WHERE a IS NOT NULL GROUP BY 1, 2, 3)"""
_COND = """u AS (SELECT split, fuel, household_id, value, 'segment' AS cond_var, segment AS cond_value FROM e UNION ALL SELECT split, fuel, household_id, value, 'region', region FROM e),
 cond AS (SELECT cond_var, cond_value, split, fuel, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, count(DISTINCT household_id) AS households FROM u WHERE cond_value IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_SEASON = """hm AS (SELECT split, fuel, household_id, month, avg(value) AS value FROM e GROUP BY ALL), se AS (SELECT split, fuel, month, avg(value) AS mean, median(value) AS median, coalesce(stddev_samp(value), 0) AS sd,
  avg(value) - 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(value)) AS low, avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(value)) AS high FROM hm WHERE value IS NOT NULL GROUP BY 1, 2, 3)"""
_PTG = "ptg AS (SELECT split, fuel, month, sum(value) / count(value) AS consumption, sum(temp_c) / count(temp_c) AS temperature FROM e GROUP BY 1, 2, 3 HAVING count(value) > 0 AND count(temp_c) > 0)"
_VARIANCE = """b AS (SELECT batch_id, household_id, dow AS step, fuel, avg(value) AS value FROM e WHERE split = 'synth' AND fuel IN ('click', 'view') GROUP BY ALL),
 rr AS (SELECT x.batch_id, x.fuel, x.household_id AS ha, y.household_id AS hb, covar_pop(x.value, y.value) / nullif(stddev_pop(x.value) * stddev_pop(y.value), 0) AS r FROM b x JOIN b y ON x.batch_id = y.batch_id AND x.fuel = y.fuel AND x.step = y.step AND x.household_id < y.household_id GROUP BY ALL),
 sc AS (SELECT *, value / nullif(avg(abs(value)) OVER (PARTITION BY batch_id, fuel, household_id), 0) AS v FROM b),
 dd AS (SELECT x.batch_id, x.fuel, x.household_id AS ha, y.household_id AS hb, sqrt(sum(pow(coalesce(x.v, 0) - coalesce(y.v, 0), 2))) AS d FROM sc x JOIN sc y ON x.batch_id = y.batch_id AND x.fuel = y.fuel AND x.step = y.step AND x.household_id < y.household_id GROUP BY ALL),
 t1 AS (SELECT batch_id, fuel, avg(r) AS mc, count_if(r > 0.95) AS hp FROM rr GROUP BY 1, 2), t2 AS (SELECT batch_id, fuel, count_if(d < 0.01 * m) AS ni FROM (SELECT *, avg(d) OVER (PARTITION BY batch_id, fuel) AS m FROM dd) GROUP BY 1, 2),
 pk AS (SELECT batch_id, fuel, household_id, arg_max(step, (value, -step)) AS peak FROM b GROUP BY 1, 2, 3), t3 AS (SELECT batch_id, fuel, max(k) / sum(k) AS cc FROM (SELECT batch_id, fuel, peak, count(*) AS k FROM pk GROUP BY 1, 2, 3) GROUP BY 1, 2),
 tests AS (SELECT batch_id, fuel, coalesce(hp > 0, false)::INT + coalesce(mc > 0.8, false)::INT + coalesce(ni > 0, false)::INT + coalesce(cc > 0.7, false)::INT AS k FROM t3 LEFT JOIN t1 USING (batch_id, fuel) LEFT JOIN t2 USING (batch_id, fuel)),
 sv AS (SELECT batch_id, sum(k) AS k FROM tests GROUP BY 1), var AS (SELECT count(*) AS batches, count_if(k BETWEEN 3 AND 4) AS medium, count_if(k > 4) AS high FROM sv)"""
_FLAGS = f"""{_E}, {_DIFF}, {_VOL}, {_ACF}, {_COND}, {_SEASON}, {_PTG}, {_VARIANCE},
 miss AS (SELECT split, fuel, 100.0 * count_if(value IS NULL) / count(*) AS missing_pct, 100.0 * count_if(value = 0) / count(*) AS zero_pct FROM e GROUP BY 1, 2),
 prof AS (SELECT split, fuel, half_hour, avg(value) AS mean FROM e GROUP BY 1, 2, 3),
 ft AS (SELECT split, fuel, avg(m) AS mean, avg(s) AS std FROM (SELECT split, fuel, avg(value) AS m, stddev_samp(value) AS s FROM e GROUP BY split, fuel, household_id, month HAVING count(value) > 0) GROUP BY 1, 2),
 slope AS (SELECT split, fuel, CASE WHEN count(*) >= 3 THEN covar_pop(temperature, consumption) / nullif(var_pop(temperature), 0) END AS slope FROM ptg GROUP BY 1, 2),
 co AS (SELECT split, fuel, avg(r) AS mean FROM (SELECT split, fuel, household_id, CASE WHEN count(*) >= 10 THEN covar_pop(value, temp_c) / nullif(stddev_pop(value) * stddev_pop(temp_c), 0) END AS r FROM e WHERE value IS NOT NULL AND temp_c IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2),
 f AS ({_flag(_wide('vol', 'fuel', 'sd p90'), "fuel || '_volatility_std'", 'sd')} UNION ALL {_flag(_wide('vol', 'fuel', 'p90'), "fuel || '_volatility_p90'", 'p90')}
 UNION ALL {_flag(_wide('miss', 'fuel', 'missing_pct'), "fuel || '_missing_pct'", 'missing_pct', 'diff')} UNION ALL {_flag(_wide('miss', 'fuel', 'zero_pct'), "fuel || '_zero_pct'", 'zero_pct', 'diff')}
 UNION ALL {_worst(_flag(_wide('acf', 'fuel, lag', 'mean'), "fuel || '_acf_max_diff'", 'mean', 'diff'))}
 UNION ALL {_rmse(_wide('prof', 'fuel, half_hour', 'mean'), "fuel || '_profile_rmse'", 1)} UNION ALL {_rmse(_wide('se', 'fuel, month', 'mean'), "fuel || '_seasonal_rmse'", 3)}
 UNION ALL {_flag(_wide('ft', 'fuel', 'mean'), "fuel || '_mean_ratio'", 'mean')} UNION ALL {_flag(_wide('ft', 'fuel', 'std'), "fuel || '_std_ratio'", 'std')}
 UNION ALL {_flag(_wide('slope', 'fuel', 'slope'), "fuel || '_ptg_slope_diff'", 'slope', 'relative', 'abs(slope_train) >= 1e-6 AND slope_synth IS NOT NULL')}
 UNION ALL {_flag(_wide('co', 'fuel', 'mean'), "fuel || '_temp_correlation_diff'", 'mean', 'diff', 'mean_synth IS NOT NULL AND mean_train IS NOT NULL')}
 UNION ALL {_worst(_flag(_wide('cond', 'cond_var, cond_value, fuel', 'mean n'), "fuel || '_conditional_mean_ratio'", 'mean', 'ratio', 'n_synth >= 10 AND n_train >= 10'))}),
 g AS (SELECT *, greatest(train_val, train_test, val_test) AS natural_variation FROM f),
 flags AS (SELECT metric, {_STATUS_NV} AS status, value, deviation, train_val, train_test, val_test, natural_variation FROM g
  UNION ALL SELECT 'within_batch_variance', CASE WHEN high > 0 THEN 'fail' WHEN medium > 0.1 * batches THEN 'warn' ELSE 'pass' END, medium + high, medium + high, NULL, NULL, NULL, NULL FROM var)"""
add("fidelity_flags", lambda s, d: sections(s, d, True)["flags"], f"{_FLAGS} SELECT * FROM flags", "value deviation train_val train_test val_test natural_variation", 5)
add("evaluation_verdict", lambda s, d: sections(s, d, True)["verdict"], f"""{_FLAGS} SELECT count(*) AS metrics, count_if(status = 'pass') AS passed, count_if(status = 'warn') AS warned, count_if(status = 'fail') AS failed,
 CASE WHEN count_if(status = 'fail') > 0 THEN 'fail' WHEN count_if(status = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS overall FROM flags""")

add("worst_batches", lambda s, d: features.worst_batches(evaluate.batch_variance(_batches(s, d))).select("batch_id", "n_flags"), f"{_E}, {_VARIANCE} SELECT batch_id, CAST(k AS INTEGER) AS n_flags FROM sv WHERE k > 0 ORDER BY k DESC, batch_id LIMIT 20")

# companion extracts
_HH = ", ".join(f"coalesce(max(CASE WHEN split = '{x}' THEN {'n' if x == 'synth' else _TEN.format('n')} END), 0) AS n_households_{x}" for x in ("synth", *_REAL))
_N = f"tot AS (SELECT split, count(DISTINCT household_id) AS n FROM e GROUP BY 1), hh AS (SELECT {_HH} FROM tot), own AS (SELECT split, CASE WHEN split = 'synth' THEN n ELSE {_TEN.format('n')} END AS n_households FROM tot)"
_three = "n_households_synth, n_households_train, n_households_test"
add("extract_marginal", lambda s, d: extracts.marginal(_readings(s, d), sections(s, d)), f"{_E}, {_N} SELECT fuel, e.split, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n_obs, {_Q7}, max(n_households) AS n_households FROM e JOIN own USING (split) GROUP BY 1, 2 HAVING count(value) > 0", "mean std " + " ".join(f"p{q}" for q in stats.QUANTILES), 4)
_small = " OR ".join(f"coalesce(households_{x} BETWEEN 1 AND 9, false)" for x in _REAL)
add("extract_conditional", lambda s, d: extracts.conditional(sections(s, d)), f"""{_E}, {_COND}, w AS (SELECT *, {_small} AS suppressed FROM {_wide('cond', 'fuel, cond_var, cond_value', 'households mean sd')})
 SELECT fuel, cond_var, cond_value, suppressed, coalesce(households_synth, 0) AS n_households_synth, {', '.join(f"CASE WHEN NOT suppressed THEN {_TEN.format(f'coalesce(households_{x}, 0)')} END AS n_households_{x}" for x in _REAL)},
 {', '.join(f"CASE WHEN NOT suppressed THEN {v}_{x} END AS {x}_{n}" for x in ('synth', *_REAL) for v, n in (('mean', 'mean'), ('sd', 'std')))}, {', '.join(f"CASE WHEN NOT suppressed THEN mean_synth / nullif(mean_{x}, 0) END AS {x}_ratio" for x in _REAL)} FROM w""",
    " ".join(f"{x}_{v}" for x in ("synth", *_REAL) for v in ("mean", "std")) + " train_ratio val_ratio test_ratio")
add("extract_acf", lambda s, d: extracts.acf(sections(s, d)), f"{_E}, {_ACF}, {_N} SELECT fuel, CAST(lag AS INTEGER) AS lag, mean_synth AS synth, mean_train AS train, mean_val AS val, mean_test AS test, mean_synth - mean_train AS train_diff, hh.* FROM {_wide('acf', 'fuel, lag', 'mean')}, hh", "synth train val test train_diff")
_PROFILE = "k AS (SELECT *, 'all' AS day_type FROM e UNION ALL SELECT *, CASE WHEN dow >= 5 THEN 'weekend' ELSE 'weekday' END FROM e), pr AS (SELECT split, fuel, day_type, half_hour, avg(value) AS mean, median(value) AS median FROM k GROUP BY 1, 2, 3, 4)"
add("extract_profiles", lambda s, d: extracts.profiles(stats.daily_profile(_readings(s, d), "split", "fuel"), sections(s, d)), f"""{_E}, {_PROFILE}, {_N} SELECT fuel, day_type, half_hour, mean_synth AS synth_mean, mean_train AS train_mean, mean_val AS val_mean, mean_test AS test_mean, median_synth AS synth_median, median_train AS train_median, hh.*
 FROM {_wide('pr', 'fuel, day_type, half_hour', 'mean median')}, hh""", "synth_mean train_mean val_mean test_mean synth_median train_median")
add("extract_volatility", lambda s, d: extracts.volatility(sections(s, d)), f"""{_E}, {_DIFF}, {_VOL}, {_N}, q AS (SELECT split, fuel, unnest(['p50', 'p75', 'p90']) AS quantile, unnest([p50, p75, p90]) AS v FROM vol)
 SELECT fuel, quantile, v_synth AS synth, v_train AS train, v_test AS test, {_three} FROM {_wide('q', 'fuel, quantile', 'v')}, hh""", "synth train test")
_hist = lambda x: f"CASE WHEN train_n >= 10 THEN {x}_n / nullif({x}_all * (2 * most / 79), 0) END AS {x}_density"
add("extract_volatility_histogram", lambda s, d: extracts.volatility_histogram(stats.differences(_readings(s, d), SERIES, list(ORDER)), sections(s, d)), f"""{_E}, {_DIFF}, {_N}, m AS (SELECT fuel, quantile_cont(abs(diff), 0.99) AS most FROM dn WHERE split = 'synth' GROUP BY 1),
 c AS (SELECT fuel, CAST(least(floor((diff + most) / (2 * most / 79)), 78) AS INTEGER) AS bin, {', '.join(f"count_if(split = '{x}') AS {x}_n" for x in ('synth', 'train', 'test'))} FROM dn JOIN m USING (fuel) WHERE abs(diff) <= most AND most > 0 GROUP BY 1, 2),
 z AS (SELECT m.fuel, most, CAST(b AS INTEGER) AS bin, {', '.join(f'coalesce({x}_n, 0) AS {x}_n' for x in ('synth', 'train', 'test'))} FROM m CROSS JOIN range(79) t(b) LEFT JOIN c ON c.fuel = m.fuel AND c.bin = b WHERE most > 0),
 a AS (SELECT *, {', '.join(f'sum({x}_n) OVER (PARTITION BY fuel) AS {x}_all' for x in ('synth', 'train', 'test'))} FROM z)
 SELECT fuel, bin, bin * (2 * most / 79) - most AS bin_left, (bin + 1) * (2 * most / 79) - most AS bin_right, train_n < 10 AS suppressed, CASE WHEN train_n >= 10 THEN synth_n END AS synth_count,
 {', '.join(f"CASE WHEN train_n >= 10 THEN {_TEN.format(f'{x}_n')} END AS {x}_count" for x in ('train', 'test'))}, {', '.join(_hist(x) for x in ('synth', 'train', 'test'))}, {_three} FROM a, hh""",
    "bin_left bin_right synth_density train_density test_density")
add("extract_ptg", lambda s, d: extracts.ptg(sections(s, d)), f"{_E}, {_PTG}, {_N} SELECT fuel, split, month, temperature AS mean_temperature, consumption AS mean_consumption, n_households FROM ptg JOIN own USING (split)", "mean_temperature mean_consumption")
add("extract_seasonal", lambda s, d: extracts.seasonal(sections(s, d)), f"{_E}, {_SEASON}, {_N} SELECT fuel, split, month, mean, median, sd AS std, low AS ci_lower, high AS ci_upper, n_households FROM se JOIN own USING (split)", "mean median std ci_lower ci_upper")

# diagnostics
_HMF = f"""{_E}, hm AS (SELECT split, fuel, household_id, month, segment, region, avg(value) AS v FROM e GROUP BY ALL HAVING avg(value) IS NOT NULL),
 lg AS (SELECT split, fuel, household_id, v, CAST(NULL AS VARCHAR) AS cond_var, CAST(NULL AS VARCHAR) AS cond_value FROM hm UNION ALL SELECT split, fuel, household_id, v, 'segment', segment FROM hm WHERE segment IS NOT NULL
  UNION ALL SELECT split, fuel, household_id, v, 'region', region FROM hm WHERE region IS NOT NULL),
 hmf AS (SELECT fuel, split, cond_var, cond_value, count(*) AS n, count(DISTINCT household_id) AS households, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, coalesce(stddev_samp(v), 0) / sqrt(count(*)) AS se,
  avg(v) - 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(*)) AS low, avg(v) + 1.96 * coalesce(stddev_samp(v), 0) / sqrt(count(*)) AS high, {', '.join(f'quantile_cont(v, {q / 100}) AS q{q}' for q in diagnostics.SHARES)} FROM lg GROUP BY 1, 2, 3, 4)"""
add("household_month_fidelity", lambda s, d: diagnostics.household_month_fidelity(_readings(s, d), ["segment", "region"]), f"{_HMF} SELECT * FROM hmf", "mean sd se low high q20 q40 q60 q80")
_TOKEN = "CAST(least(floor(value / 25), 7) AS INTEGER)"


def _week_tokens(s: SparkSession, d: str) -> DataFrame:
    own = E(s, d).withColumn("token", F.least(F.floor(F.col("value") / 25), F.lit(7)).cast("int"))
    weeks = own.where("split = 'synth'").withColumn("week", (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("int"))
    means = s.range(8).select(F.col("id").cast("int").alias("token"), (F.col("id") * 25 + 12.5).alias("value"))
    return diagnostics.weekly_tokens(weeks, own.where("split = 'train'"), 8, means)


add("weekly_token_metrics", _week_tokens, f"""{EVENTS}, t AS (SELECT CAST((day(ts) - 1) // 7 + 1 AS INTEGER) AS week, {_TOKEN} AS token FROM readings WHERE split = 'synth' UNION ALL SELECT 0, {_TOKEN} FROM readings WHERE split = 'train'),
 fq AS (SELECT week, token, n, n / sum(n) OVER (PARTITION BY week) AS f FROM (SELECT w.week, b AS token, count(t.token) AS n FROM (SELECT DISTINCT week FROM t) w CROSS JOIN range(8) r(b) LEFT JOIN t ON t.week = w.week AND t.token = b GROUP BY 1, 2)),
 m AS (SELECT week, sum(n)::BIGINT AS n, stddev_pop(f) AS sd, sum(CASE WHEN token < 4 THEN f ELSE 0 END) AS lower_half, sum(CASE WHEN token >= 4 THEN f ELSE 0 END) AS upper_half, -sum(CASE WHEN f > 0 THEN f * log2(f) ELSE 0 END) AS entropy,
  sum(f * (token * 25 + 12.5)) AS implied_mean FROM fq GROUP BY 1)
 SELECT m.*, m.entropy - b.entropy AS entropy_diff, m.implied_mean - b.implied_mean AS mean_diff FROM m, (SELECT * FROM m WHERE week = 0) b""", "sd lower_half upper_half entropy implied_mean entropy_diff mean_diff")
add("daily_pattern_findings", lambda s, d: diagnostics.daily_patterns(_readings(s, d), ORDER, 12)["findings"], f"""{_E}, p AS (SELECT fuel, half_hour, avg(CASE WHEN split = 'synth' THEN value END) AS x, avg(CASE WHEN split = 'train' THEN value END) AS y FROM e GROUP BY 1, 2),
 c AS (SELECT fuel, (stddev_pop(x) / avg(x)) / (stddev_pop(y) / avg(y)) AS cv_ratio, covar_pop(x, y) / nullif(stddev_pop(CASE WHEN y IS NOT NULL THEN x END) * stddev_pop(CASE WHEN x IS NOT NULL THEN y END), 0) AS corr, (max(x) - min(x)) / (max(y) - min(y)) AS amplitude FROM p GROUP BY 1)
 SELECT *, concat_ws('; ', CASE WHEN cv_ratio < 0.5 THEN 'flat' END, CASE WHEN corr < 0.5 THEN 'shape mismatch' END, CASE WHEN amplitude < 0.7 THEN 'reduced amplitude' END) AS findings FROM c""", "cv_ratio corr amplitude")
_count = lambda name, position, result, n: f"SELECT '{name}' AS diagnostic, {position} AS position, 'completed' AS status, '{result}' AS result, ({n}) AS rows, CAST(NULL AS VARCHAR) AS error"
_groups = lambda keys, where="value IS NOT NULL", source="e": f"SELECT count(*) FROM (SELECT DISTINCT {keys} FROM {source} WHERE {where})"
_SUITE = " UNION ALL ".join([
    _count("collapse", 1, "seasonal", _groups("split, fuel, month")), _count("collapse", 1, "collapse", _groups("split, fuel")), _count("daily_patterns", 2, "profile", _groups("split, fuel, half_hour", "true")),
    _count("daily_patterns", 2, "patterns", _groups("split, fuel", "true")), _count("daily_patterns", 2, "findings", _groups("fuel", "true")), _count("daily_patterns", 2, "weekly", _groups("split, fuel, week", "true", "wk")),
    _count("daily_patterns", 2, "degraded", _groups("split, fuel", "week = 1", "wk")), _count("household_month_fidelity", 3, "household_months", "SELECT count(*) FROM hmf"),
    "SELECT 'token_distribution', 4, 'failed', CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), 'ValueError: bin edges are needed for the token distribution'",
])
add("diagnostics_suite", lambda s, d: diagnostics.suite(_readings(s, d), ["segment", "region"], None, ORDER, 12)[0], f"""{_HMF}, wk AS (SELECT *, (row_number() OVER (PARTITION BY split, household_id, fuel ORDER BY ts, event_id) - 1) // 12 + 1 AS week FROM e)
 SELECT diagnostic, CAST(position AS INTEGER) AS position, status, result, rows, error FROM ({_SUITE})""")

# a generation run, context tuples


def _run(s: SparkSession, d: str) -> dict[str, DataFrame]:
    days = _day_tokens(s, d)
    train = days.where("split = 'train'")
    pool = days.where("split = 'test'").select("household_id").distinct()
    means = s.range(8).select(F.col("id").cast("int").alias("token"), (F.col("id") * 20 + 10.0).alias("value"), F.explode(F.array(F.lit("elec"), F.lit("gas"))).alias("fuel"))
    return synthesis.run(pool, train, train.select("household_id", "month", "day", "odd"), means, 60, {"elec": 8, "gas": 8}, ["month"], ["odd"], order="day")


_RUN = f"""{_DAYS}, pool AS (SELECT DISTINCT household_id FROM tok WHERE split = 'test'), k AS (SELECT count(*) AS have FROM pool),
 cp AS (SELECT household_id, c FROM pool, k, range(60) t(c) WHERE c < greatest(1, ceil(60.0 / greatest(have, 1)))),
 sm AS (SELECT household_id || '-' || c AS sample_id FROM cp ORDER BY c, {_rank('household_id')}, household_id LIMIT 60),
 tp AS (SELECT household_id, row_number() OVER (ORDER BY {_rank('household_id')}, household_id) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT household_id FROM tok WHERE split = 'train')),
 pk AS (SELECT sample_id, household_id AS template_id FROM sm JOIN tp ON r = {_rank('sample_id')} % n)"""
add("synthesis_samples", lambda s, d: _run(s, d)["samples"].select("sample_id", "template_id"), f"{_RUN} SELECT * FROM pk")
add("synthesis_summary", lambda s, d: _run(s, d)["summary"], f"""{_RUN} SELECT sample_id, count(DISTINCT month) AS months, count(*) AS steps, false AS failed FROM pk JOIN tok ON household_id = template_id GROUP BY 1""")
add("context_tuples", lambda s, d: context_tuples(table(s, d, "customer").select("c_custkey", F.when(F.col("c_nationkey") > 4, F.col("c_nationkey")).alias("B5"), F.lit(None).cast("int").alias("C1_new")), H(s, d), "val", key="c_custkey"),
    "SELECT c_custkey AS household_id, CASE WHEN c_nationkey > 4 THEN c_nationkey ELSE 0 END AS B5, 0 AS C1_new FROM customer WHERE c_custkey % 4 = 2")
