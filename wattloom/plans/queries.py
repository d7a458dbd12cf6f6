"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import compare, features, filters, generate, grade, pairs, privacy, sequences, splits, stats, training, vocab
from ..operators.shared import series_table, shared_dir
from ..sources import fixtures
from ..sources.matrices import read_matrix, write_matrix
from ..sources.readers import event_readings, household_list, household_metadata, join_metadata, line_readings, listed, table, wide_to_long
from ..sources.writers import wide_month, write_household_list
from ..streaming.half_hours import resample
from . import evaluate

_STATUS_NV = "CASE WHEN natural_variation IS NULL OR deviation IS NULL THEN 'warn' WHEN deviation <= natural_variation THEN 'pass' WHEN deviation <= 3 * natural_variation THEN 'warn' ELSE 'fail' END"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SPLIT = "CASE {0} % 4 WHEN 0 THEN 'synth' WHEN 1 THEN 'train' WHEN 2 THEN 'val' ELSE 'test' END"
EVENTS = f"""WITH readings AS (SELECT user_id AS household_id, {_SPLIT.format('user_id')} AS split, user_id // 10 AS batch_id, event_id, ts,
 month(ts) AS month, isodow(ts) - 1 AS dow, hour(ts) * 2 + minute(ts) // 30 + 1 AS half_hour, event_type AS fuel, value FROM events)"""
LINES = f"""WITH readings AS (SELECT l_suppkey AS household_id, {_SPLIT.format('l_suppkey')} AS split, l_returnflag AS fuel, month(l_shipdate) AS month,
 isodow(l_shipdate) - 1 AS dow, l_shipdate, l_orderkey, l_linenumber, l_quantity AS value, l_extendedprice AS price, l_discount AS zero_value, l_tax AS tax FROM lineitem)"""
HOMES = f"""homes AS (SELECT c_custkey AS household_id, c_mktsegment AS segment, n_name AS nation, r_name AS region, c_acctbal AS balance,
 {_SPLIT.format('c_custkey')} AS split FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""
_Q7 = ", ".join(f"quantile_cont(value, {q / 100}) AS p{q}" for q in stats.QUANTILES)


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, doubles: str = "", digits: int = 6) -> None:
    """doubles: columns rounded on both sides."""
    names = doubles.split()

    def query(spark: SparkSession, folder: str) -> DataFrame:
        out = run(spark, folder)
        return out.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in names}) if names else out

    QUERIES[name] = query
    if sql:
        SQL[name] = f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), {digits}) AS {c}' for c in names)}) FROM ({sql})" if names else sql


E, L, H = event_readings, line_readings, household_metadata
KEY = ["household_id", "fuel"]
ORDER = ["ts", "event_id"]


def _sql_moments(by: str, source: str = "readings", value: str = "value") -> str:
    return f"SELECT {by}, count({value}) AS n, sum({value}) AS total, avg({value}) AS mean, var_pop({value}) AS var, stddev_pop({value}) AS sd, min({value}) AS least, max({value}) AS most, {_Q7.replace('value', value)} FROM {source} GROUP BY {by}"


# marginal and conditional summaries
add("daily_profile", lambda s, d: stats.daily_profile(E(s, d), "fuel"), f"""{EVENTS}, kinds AS (SELECT *, 'all' AS day_type FROM readings UNION ALL SELECT *, CASE WHEN dow >= 5 THEN 'weekend' ELSE 'weekday' END FROM readings)
 SELECT fuel, day_type, half_hour, count(value) AS n, sum(value) AS total, avg(value) AS mean, median(value) AS median, CASE WHEN count(value) > 1 THEN stddev_pop(value) / sqrt(count(value)) ELSE 0.0 END AS se FROM kinds GROUP BY 1, 2, 3""", "total mean median se")
add("marginal_stats", lambda s, d: stats.fuel_stats(E(s, d), "split", "fuel"), f"{EVENTS} {_sql_moments('split, fuel')}", "total mean var sd p5 p10 p25 p50 p75 p90 p95", 4)
_parts = ", ".join(f"sum(p{q} * n) / sum(n) AS p{q}" for q in stats.QUANTILES)
add("marginal_combined", lambda s, d: stats.combined(stats.fuel_stats(E(s, d), "batch_id", "fuel"), "fuel"), f"""{EVENTS}, part AS ({_sql_moments('batch_id, fuel')})
 SELECT fuel, CAST(sum(n) AS BIGINT) AS n, sum(total) AS total, sum(mean * n) / sum(n) AS mean, greatest(sum((var + mean * mean) * n) / sum(n) - pow(sum(mean * n) / sum(n), 2), 0) AS var, min(least) AS least, max(most) AS most, {_parts} FROM part GROUP BY fuel""", "total mean var p5 p10 p25 p50 p75 p90 p95", 4)
_wide = ", ".join(f"max(CASE WHEN split = '{x}' THEN {v} END) AS {v}_{x}" for v in ["mean", "sd", *[f"p{q}" for q in stats.QUANTILES]] for x in ("synth", "train"))
_mae = " + ".join(f"abs(p{q}_synth - p{q}_train) / p{q}_train" for q in stats.QUANTILES)
_STATUS = "CASE WHEN {0} IS NULL THEN 'no_comparison_data' WHEN {0} BETWEEN 0.8 AND 1.2 THEN 'pass' WHEN {0} BETWEEN 0.5 AND 2.0 THEN 'warn' ELSE 'fail' END"
add("marginal_comparison", lambda s, d: stats.marginal_comparison(E(s, d), "fuel"), f"""{EVENTS}, m AS ({_sql_moments('split, fuel')}), w AS (SELECT fuel, {_wide} FROM m GROUP BY fuel)
 SELECT fuel, mean_synth / mean_train AS mean_ratio, sd_synth / sd_train AS sd_ratio, ({_mae}) / 7 AS quantile_mae, {_STATUS.format('mean_synth / mean_train')} AS status FROM w""", "mean_ratio sd_ratio quantile_mae")
add("monthly_sums", lambda s, d: stats.monthly_sums(L(s, d), "split", "fuel"), f"{LINES} SELECT split, fuel, month, sum(value) AS total, count(value) AS n FROM readings GROUP BY 1, 2, 3", "total")
_joined = lambda s, d: E(s, d).drop("split").join(H(s, d), "household_id")
add("conditional_stats", lambda s, d: stats.conditional(_joined(s, d), ["segment", "region"], "split", "fuel"), f"""{EVENTS}, {HOMES}, j AS (SELECT r.fuel, r.value, h.* FROM readings r JOIN homes h USING (household_id)),
 u AS (SELECT split, fuel, household_id, value, 'segment' AS cond_var, segment AS cond_value FROM j UNION ALL SELECT split, fuel, household_id, value, 'region', region FROM j)
 SELECT cond_var, cond_value, split, fuel, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, count(DISTINCT household_id) AS households FROM u WHERE cond_value IS NOT NULL GROUP BY 1, 2, 3, 4""", "mean sd")
add("group_means", lambda s, d: stats.group_means(_joined(s, d), "segment", "split"), f"""{EVENTS}, {HOMES} SELECT h.split, segment, avg(value) AS mean, stddev_samp(value) AS sd, count(value) AS n FROM readings r JOIN homes h USING (household_id) GROUP BY 1, 2""", "mean sd")
add("household_months", lambda s, d: stats.household_months(L(s, d), "split"), f"{LINES} SELECT household_id, month, fuel, split, avg(value) AS mean, count(value) AS n FROM readings GROUP BY 1, 2, 3, 4", "mean")
_CI = "count(value) AS n, avg(value) AS mean, median(value) AS median, coalesce(stddev_samp(value), 0) AS sd, coalesce(stddev_samp(value), 0) / sqrt(count(value)) AS se, avg(value) - 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(value)) AS low, avg(value) + 1.96 * coalesce(stddev_samp(value), 0) / sqrt(count(value)) AS high"
_SEASON = f"{LINES}, homes AS (SELECT split, fuel, household_id, month, avg(value) AS value FROM readings GROUP BY ALL), season AS (SELECT split, fuel, month, {_CI} FROM homes GROUP BY 1, 2, 3)"
add("seasonal", lambda s, d: stats.seasonal(L(s, d), "split", "fuel"), f"{_SEASON} SELECT * FROM season", "mean median sd se low high")
add("collapse_ratio", lambda s, d: stats.collapse(stats.seasonal(L(s, d), "split", "fuel"), "split", "fuel"), f"""{_SEASON}, c AS (SELECT split, fuel, max(CASE WHEN month = 12 THEN mean END) / max(CASE WHEN month = 1 THEN mean END) AS collapse_ratio FROM season GROUP BY 1, 2)
 SELECT *, CASE WHEN collapse_ratio IS NULL THEN 'unknown' WHEN collapse_ratio < 0.5 THEN 'severe' WHEN collapse_ratio < 0.8 THEN 'moderate' WHEN collapse_ratio < 1.2 THEN 'stable' ELSE 'growth' END AS band FROM c""", "collapse_ratio")
add("distribution", lambda s, d: stats.distribution(E(s, d), "fuel"), f"{EVENTS} SELECT fuel, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS least, max(value) AS most, quantile_cont(value, 0.05) AS p5, quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.95) AS p95 FROM readings GROUP BY fuel", "mean sd p5 p25 median p75 p95", 4)
add("quintiles", lambda s, d: stats.quintiles(E(s, d), "split"), f"{EVENTS} SELECT split, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, min(value) AS least, max(value) AS most, quantile_cont(value, 0.2) AS q20, quantile_cont(value, 0.4) AS q40, quantile_cont(value, 0.6) AS q60, quantile_cont(value, 0.8) AS q80 FROM readings GROUP BY split", "mean sd q20 q40 q60 q80", 4)
add("distribution_shift", lambda s, d: stats.distribution_shift(E(s, d), E(s, d).where("household_id % 7 <> 0")), f"""{EVENTS}, a AS (SELECT count(value) n, avg(value) m, median(value) md, stddev_pop(value) sd FROM readings), k AS (SELECT count(value) n, avg(value) m, median(value) md, stddev_pop(value) sd FROM readings WHERE household_id % 7 <> 0)
 SELECT a.n AS n_all, k.n AS n_kept, k.m - a.m AS mean_shift, k.md - a.md AS median_shift, k.sd - a.sd AS sd_shift, 100 * (k.m - a.m) / a.m AS mean_shift_pct, abs(100 * (k.m - a.m) / a.m) > 5 AS warn FROM a, k""", "mean_shift median_shift sd_shift mean_shift_pct")
add("run_totals", lambda s, d: E(s, d).groupBy("split").agg(F.count_distinct("batch_id").alias("batches"), F.count_distinct("household_id").alias("households"), F.count_distinct("month").alias("months")), f"{EVENTS} SELECT split, count(DISTINCT batch_id) AS batches, count(DISTINCT household_id) AS households, count(DISTINCT month) AS months FROM readings GROUP BY split")
add("with_ci", lambda s, d: stats.with_ci(E(s, d), "fuel"), f"{EVENTS} SELECT fuel, {_CI} FROM readings GROUP BY fuel", "mean median sd se low high")

# households, filters, joins
add("metadata_join", lambda s, d: H(s, d), f"WITH {HOMES} SELECT * FROM homes")
add("household_missingness", lambda s, d: filters.missingness(L(s, d).withColumn("value", F.when(F.col("zero_value") != 0, F.col("value")))), f"{LINES} SELECT household_id, fuel, count(*) AS n, avg(CASE WHEN zero_value = 0 THEN 1.0 ELSE 0.0 END) AS missing, avg(CASE WHEN zero_value <> 0 THEN value END) AS mean FROM readings GROUP BY 1, 2", "missing mean")


def _catalog(s: SparkSession, d: str) -> DataFrame:
    r = L(s, d).select("household_id", F.when(F.col("fuel") == "A", "electricity").when(F.col("fuel") == "N", "gas").alias("fuel"), F.when(F.col("zero_value") != 0, F.col("value")).alias("value"))
    homes = H(s, d).select("household_id", "segment", F.when(F.col("household_id") % 11 != 0, F.col("region")).alias("region"), (F.col("household_id") % 7 == 0).alias("has_pv"))
    return filters.attach_missingness(homes, r)


_CATALOG = f"""{LINES}, {HOMES}, m AS (SELECT household_id, avg(CASE WHEN fuel = 'A' THEN CASE WHEN zero_value = 0 THEN 1.0 ELSE 0.0 END END) AS em, avg(CASE WHEN fuel = 'N' THEN CASE WHEN zero_value = 0 THEN 1.0 ELSE 0.0 END END) AS gm FROM readings GROUP BY 1),
 cat AS (SELECT h.household_id, segment, CASE WHEN h.household_id % 11 <> 0 THEN region END AS region, h.household_id % 7 = 0 AS has_pv, coalesce(em, 1) AS em, coalesce(gm, 1) AS gm FROM homes h LEFT JOIN m USING (household_id)),
 first AS (SELECT * FROM cat WHERE NOT has_pv AND em < 0.2 AND gm < 0.2 AND segment IS NOT NULL AND region IS NOT NULL),
 sizes AS (SELECT segment, region, count(*) AS k_group_size FROM first GROUP BY 1, 2)"""
_VARS = ["segment", "region"]
add("filter_households", lambda s, d: filters.filter_households(_catalog(s, d), _VARS, 2)[0].select("household_id", *_VARS, "k_group_size"), f"{_CATALOG} SELECT household_id, segment, region, k_group_size FROM first JOIN sizes USING (segment, region) WHERE k_group_size >= 2")
add("filter_report", lambda s, d: filters.filter_households(_catalog(s, d), _VARS, 2)[1], f"""{_CATALOG}, n AS (SELECT count(*) AS n0, count_if(NOT has_pv) AS n1, count_if(NOT has_pv AND em < 0.2 AND gm < 0.2) AS n2, count_if(NOT has_pv AND em < 0.2 AND gm < 0.2 AND segment IS NOT NULL AND region IS NOT NULL) AS n3,
 (SELECT coalesce(sum(k_group_size), 0)::BIGINT FROM sizes WHERE k_group_size >= 2) AS n4 FROM cat)
 SELECT 'not_exporter' AS stage, 1 AS position, n1 AS n, n0 - n1 AS removed, 100.0 * n1 / n0 AS pct FROM n UNION ALL SELECT 'complete', 2, n2, n1 - n2, 100.0 * n2 / n0 FROM n UNION ALL SELECT 'known', 3, n3, n2 - n3, 100.0 * n3 / n0 FROM n UNION ALL SELECT 'k_group', 4, n4, n3 - n4, 100.0 * n4 / n0 FROM n""", "pct", 4)
add("exporter_anti_join", lambda s, d: filters.without_exporters(H(s, d), H(s, d).where("household_id % 7 = 0").select(F.col("household_id").alias("puprn"))).select("household_id", "region"), f"WITH {HOMES} SELECT household_id, region FROM homes WHERE household_id % 7 <> 0")
add("category_report", lambda s, d: filters.category_report(H(s, d), ["segment", "region"]), f"WITH {HOMES}, u AS (SELECT 'segment' AS variable, segment AS value FROM homes UNION ALL SELECT 'region', region FROM homes) SELECT variable, value, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY variable) AS pct FROM u GROUP BY 1, 2", "pct", 4)
_codes = lambda s, d: filters.negative_to_null(table(s, d, "customer").select("c_custkey", (F.col("c_nationkey") % 12 - 2).alias("code"), (F.col("c_nationkey") % 9 - 1).alias("ev")), ["code"])


def _case(x: str, names: dict[int, str], above: str = "") -> str:
    return f"CASE {' '.join(f'WHEN {x} = {k} THEN ' + chr(39) + v.replace(chr(39), chr(39) * 2) + chr(39) for k, v in names.items())} {above} ELSE 'Unknown' END"


add("survey_categories", lambda s, d: _codes(s, d).select(
    "c_custkey", filters.coded(F.col("code"), filters.BUILDING, (5, "Other")).alias("building"), filters.coded(F.col("code"), filters.AGE_BUILT).alias("age_built"), filters.coded(F.col("code"), filters.TENURE).alias("tenure"),
    filters.coded(F.col("code"), filters.MANAGING).alias("managing"), filters.coded(F.col("ev"), filters.HAS_EV).alias("has_ev"), filters.bucket(F.col("code"), 3, 9).alias("rooms"), filters.bucket(F.col("code"), None, 5).alias("occupants")),
    f"""WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 12 - 2 >= 0 THEN c_nationkey % 12 - 2 END AS code, c_nationkey % 9 - 1 AS ev FROM customer)
 SELECT c_custkey, {_case('code', filters.BUILDING, "WHEN code >= 5 THEN 'Other'")} AS building, {_case('code', filters.AGE_BUILT)} AS age_built, {_case('code', filters.TENURE)} AS tenure, {_case('code', filters.MANAGING)} AS managing, {_case('ev', filters.HAS_EV)} AS has_ev,
 CASE WHEN code <= 3 THEN '1-3' WHEN code >= 9 THEN '9+' ELSE CAST(code AS VARCHAR) END AS rooms, CASE WHEN code >= 5 THEN '5+' ELSE CAST(code AS VARCHAR) END AS occupants FROM c""")
_heat = lambda s, d: table(s, d, "customer").select("c_custkey", *[F.when(F.col("c_custkey") % (i + 2) == 0, 1).otherwise(0).alias(f"A3{i:02d}") for i in range(1, 11)])
add("heating_type", lambda s, d: _heat(s, d).select("c_custkey", filters.heating_type().alias("heating_type")), """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'No central heating' WHEN c_custkey % 4 = 0 THEN 'Gas central heating' WHEN c_custkey % 5 = 0 OR c_custkey % 6 = 0 OR c_custkey % 7 = 0 THEN 'Electric heating'
 WHEN c_custkey % 8 = 0 OR c_custkey % 9 = 0 OR c_custkey % 10 = 0 OR c_custkey % 11 = 0 OR c_custkey % 12 = 0 THEN 'Other heating' ELSE 'Unknown' END AS heating_type FROM customer""")
add("context_validity", lambda s, d: table(s, d, "customer").select("c_custkey", (F.col("c_custkey") % 5 == 0).alias("B5_err"), (F.col("c_custkey") % 7 == 0).alias("A3_err"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey") % 2 == 0).alias("A1_err")).where(filters.valid_context()).select("c_custkey"),
    "SELECT c_custkey FROM customer WHERE NOT c_custkey % 5 = 0 AND NOT c_custkey % 7 = 0 AND NOT coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 2 = 0 END, FALSE)")
add("split_counts", lambda s, d: splits.split_counts(H(s, d)), f"WITH {HOMES} SELECT split, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM homes GROUP BY split", "pct", 2)
add("region_merge", lambda s, d: table(s, d, "region").select("r_regionkey", filters.merged_region(F.when(F.col("r_regionkey") == 0, "NORTH EAST").when(F.col("r_regionkey") == 1, "NORTH WEST").otherwise(F.col("r_name"))).alias("region")), "SELECT r_regionkey, CASE WHEN r_regionkey <= 1 THEN 'NORTH' ELSE r_name END AS region FROM region")

# k-anonymity and disclosure control
_G = f"WITH {HOMES}, g AS (SELECT segment, nation, count(*) AS size FROM homes WHERE segment IS NOT NULL AND nation IS NOT NULL GROUP BY 1, 2)"
_KV = ["segment", "nation"]
add("k_groups", lambda s, d: privacy.k_groups(H(s, d), _KV, 10), f"{_G} SELECT *, size >= 10 AS qualifies FROM g")
add("k_summary", lambda s, d: privacy.k_summary(H(s, d), _KV, 10), f"{_G} SELECT count(*) AS groups, count_if(size >= 10) AS qualifying, sum(size)::BIGINT AS households, coalesce(sum(CASE WHEN size >= 10 THEN size END), 0)::BIGINT AS kept, min(size) AS smallest, max(size) AS largest, avg(size) AS mean, median(size) AS median FROM g", "mean median")
add("k_members", lambda s, d: privacy.k_members(H(s, d), _KV, 10).select("household_id", *_KV, "k_group_size"), f"{_G} SELECT household_id, segment, nation, size AS k_group_size FROM homes JOIN g USING (segment, nation) WHERE size >= 10")


def _half_hours(s: SparkSession, d: str) -> DataFrame:
    return E(s, d).groupBy("household_id", "fuel", "half_hour").agg(F.avg("value").alias("value")).withColumnRenamed("half_hour", "ts")


_days_of = lambda s, d: E(s, d).groupBy("household_id", "fuel", F.col("dow").alias("ts")).agg(F.avg("value").alias("value"))
_rank = lambda *parts: "CAST('0x' || substr(md5(" + " || ':' || ".join([*(f"CAST({p} AS VARCHAR)" for p in parts), "'42'"]) + "), 1, 12) AS BIGINT)"
_KAGG = f"""{EVENTS}, {HOMES}, m AS (SELECT household_id, region FROM homes WHERE household_id IN (SELECT household_id FROM readings)), g AS (SELECT region, count(*) AS k_group_size FROM m GROUP BY 1 HAVING count(*) >= 3),
 ch AS (SELECT household_id, region FROM m QUALIFY row_number() OVER (PARTITION BY region ORDER BY {_rank('household_id')}, household_id) <= 3), dw AS (SELECT household_id, fuel, dow AS ts, avg(value) AS value FROM readings GROUP BY ALL)"""


def _k_aggregates(s: SparkSession, d: str, method: str = "mean") -> DataFrame:
    members = H(s, d).join(E(s, d).select("household_id").distinct(), "household_id", "left_semi")
    return privacy.k_aggregates(_days_of(s, d), members, ["region"], 3, method)


add("k_aggregates", _k_aggregates, f"{_KAGG} SELECT region, k_group_size, fuel, ts, avg(value) AS value FROM ch JOIN g USING (region) JOIN dw USING (household_id) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT household_id) = 3", "value")
add("k_aggregates_median", lambda s, d: _k_aggregates(s, d, "median"), f"{_KAGG} SELECT region, k_group_size, fuel, ts, median(value) AS value FROM ch JOIN g USING (region) JOIN dw USING (household_id) GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT household_id) = 3", "value")
_trios = lambda s, d: E(s, d).select("household_id").distinct().withColumn("trio", F.floor(F.col("household_id") / 3))
add("k_aggregate_trios", lambda s, d: privacy.k_aggregates(_half_hours(s, d), _trios(s, d), ["trio"], 3), f"""{EVENTS}, h AS (SELECT household_id, fuel, half_hour AS ts, avg(value) AS value FROM readings GROUP BY ALL)
 SELECT household_id // 3 AS trio, 3 AS k_group_size, fuel, ts, avg(value) AS value FROM h GROUP BY 1, fuel, ts HAVING count(DISTINCT household_id) = 3""", "value")
_MASKED = f"""WITH {HOMES}, b AS (SELECT household_id, region, segment, nation, split FROM homes WHERE region IS NOT NULL AND segment IS NOT NULL AND nation IS NOT NULL),
 l AS (SELECT household_id, a AS augmentation, v AS variable, CASE v WHEN 'nation' THEN nation WHEN 'segment' THEN segment ELSE split END AS value,
  CAST('0x' || substr(md5(household_id || ':' || a || ':' || v || ':42'), 1, 12) AS BIGINT) AS h FROM b, range(2) t(a), (VALUES ('nation'), ('segment'), ('split')) u(v)),
 o AS (SELECT *, row_number() OVER (PARTITION BY household_id, augmentation ORDER BY h, variable) AS pos FROM l),
 p AS (SELECT household_id, augmentation, e AS extra, coalesce(string_agg(variable, '|' ORDER BY pos) FILTER (pos <= e), '') AS vs, coalesce(string_agg(value, '|' ORDER BY pos) FILTER (pos <= e), '') AS vals,
  coalesce(string_agg(variable || '=' || value, '|' ORDER BY variable) FILTER (pos <= e), '') AS k FROM o, range(4) t(e) GROUP BY 1, 2, 3),
 w AS (SELECT household_id, region, concat_ws('|', CASE WHEN m & 1 > 0 THEN 'nation=' || nation END, CASE WHEN m & 2 > 0 THEN 'segment=' || segment END, CASE WHEN m & 4 > 0 THEN 'split=' || split END) AS k FROM b, range(8) t(m)),
 z AS (SELECT region, k, count(*) AS group_size FROM w GROUP BY 1, 2),
 masked AS (SELECT household_id, CAST(augmentation AS INTEGER) AS augmentation, 'region' || CASE WHEN extra > 0 THEN '|' || vs ELSE '' END AS variables, region || CASE WHEN extra > 0 THEN '|' || vals ELSE '' END AS "values",
  CAST(extra + 1 AS INTEGER) AS var_count, group_size FROM p JOIN b USING (household_id) JOIN z USING (region, k) WHERE group_size >= 3)"""


def _masked(s: SparkSession, d: str, most: int | None = None, best: bool = False) -> DataFrame:
    out = privacy.masked_contexts(H(s, d), ["region"], ["segment", "nation", "split"], 3, augmentations=2)
    out = privacy.best_contexts(out, most) if best else out
    return out.withColumns({c: F.array_join(c, "|") for c in ("variables", "values")})


_best = lambda most: f"{_MASKED} SELECT * FROM masked WHERE var_count <= {most} QUALIFY row_number() OVER (PARTITION BY household_id, augmentation ORDER BY var_count DESC) = 1"
add("masked_contexts", _masked, f"{_MASKED} SELECT * FROM masked")
add("best_contexts", lambda s, d: _masked(s, d, 2, True), _best(2))
add("unconstrained_contexts", lambda s, d: _masked(s, d, None, True), _best(99))
_excluded = lambda s, d: L(s, d).withColumn("batch_id", F.floor(F.col("household_id") / 10)).select("batch_id", "household_id", "month").distinct().where("(household_id * 7 + month) % 5 = 0 OR household_id % 9 = 0")
_EXCL = f"{LINES}, b AS (SELECT *, household_id // 10 AS batch_id FROM readings), c AS (SELECT DISTINCT batch_id, household_id, month, (household_id * 7 + month) % 5 = 0 OR household_id % 9 = 0 AS x FROM b)"
_batched = lambda s, d: L(s, d).withColumn("batch_id", F.floor(F.col("household_id") / 10))
add("prefilter_report", lambda s, d: privacy.prefilter(_batched(s, d), _excluded(s, d))[1], f"""{_EXCL}, h AS (SELECT batch_id, household_id, bool_and(x) AS f, bool_or(x) AS a FROM c GROUP BY 1, 2), m AS (SELECT batch_id, month, bool_and(x) AS e FROM c GROUP BY 1, 2)
 SELECT h.batch_id, households, fully_excluded, partly_excluded, months_emptied FROM (SELECT batch_id, count(*) AS households, count_if(f) AS fully_excluded, count_if(a AND NOT f) AS partly_excluded FROM h GROUP BY 1) h JOIN (SELECT batch_id, count_if(e) AS months_emptied FROM m GROUP BY 1) m USING (batch_id)""")
add("prefilter", lambda s, d: privacy.prefilter(_batched(s, d), _excluded(s, d))[0].groupBy("batch_id", "month").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")), f"{_EXCL} SELECT batch_id, month, count(*) AS n, sum(value) AS total FROM b WHERE NOT ((household_id * 7 + month) % 5 = 0 OR household_id % 9 = 0) GROUP BY 1, 2", "total")
add("sdc_rounding", lambda s, d: privacy.rounded(privacy.k_groups(H(s, d), _KV, 10).select(*_KV, "size"), ["size"]), f"{_G} SELECT segment, nation, (round_even(size / 10, 0) * 10)::BIGINT AS size FROM g")
_cells = lambda s, d: _joined(s, d).groupBy("nation", "fuel").agg(F.count_distinct("household_id").alias("households"), F.avg("value").alias("mean"))
add("sdc_suppression", lambda s, d: privacy.suppressed(_cells(s, d), ["nation"], ["households"], ["mean"]), f"""{EVENTS}, {HOMES}, c AS (SELECT nation, fuel, count(DISTINCT r.household_id) AS households, avg(value) AS mean FROM readings r JOIN homes USING (household_id) GROUP BY 1, 2),
 s AS (SELECT *, bool_or(households > 0 AND households < 10) OVER (PARTITION BY nation) AS suppressed FROM c)
 SELECT nation, fuel, CASE WHEN NOT suppressed THEN (round_even(households / 10, 0) * 10)::BIGINT END AS households, CASE WHEN NOT suppressed THEN mean END AS mean, suppressed FROM s""", "mean")

# windows and runs
_D = f"{EVENTS}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY household_id, fuel ORDER BY ts, event_id) AS diff FROM readings WHERE value IS NOT NULL)"
add("first_differences", lambda s, d: stats.differences(E(s, d), KEY, ORDER).select("household_id", "fuel", "event_id", "diff"), f"{_D} SELECT household_id, fuel, event_id, diff FROM d WHERE diff IS NOT NULL", "diff")
add("volatility", lambda s, d: stats.diff_quantiles(stats.differences(E(s, d), KEY, ORDER), "split", "fuel"), f"""{_D} SELECT split, fuel, count(diff) AS n, stddev_pop(diff) AS sd, (kurtosis_pop(diff) + 3) * pow((count(diff) - 1.0) / count(diff), 2) - 3 AS excess_kurtosis,
 quantile_cont(abs(diff), 0.5) AS p50, quantile_cont(abs(diff), 0.75) AS p75, quantile_cont(abs(diff), 0.9) AS p90, quantile_cont(abs(diff), 0.95) AS p95 FROM d WHERE diff IS NOT NULL GROUP BY 1, 2""", "sd excess_kurtosis p50 p75 p90 p95", 4)
add("rolling_volatility", lambda s, d: stats.rolling_sd(E(s, d), KEY, ORDER, 6).select("household_id", "fuel", "event_id", "vol"), f"""{EVENTS}, w AS (SELECT household_id, fuel, event_id, stddev_samp(value) OVER (PARTITION BY household_id, fuel ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS vol, row_number() OVER (PARTITION BY household_id, fuel ORDER BY ts, event_id) AS n FROM readings)
 SELECT household_id, fuel, event_id, vol FROM w WHERE n >= 6""", "vol", 5)
_ACF = " UNION ALL ".join(f"SELECT household_id, split, fuel, {k} AS lag, covar_pop(CASE WHEN l{k} IS NOT NULL THEN value END, l{k}) / nullif(stddev_pop(CASE WHEN l{k} IS NOT NULL THEN value END) * stddev_pop(l{k}), 0) AS acf FROM b WHERE n > 5 GROUP BY household_id, split, fuel" for k in (1, 2, 4))
_lags = ", ".join(f"lag(value, {k}) OVER w AS l{k}" for k in (1, 2, 4))
add("autocorrelation", lambda s, d: stats.acf_summary(stats.autocorrelation(E(s, d), ["household_id", "split", "fuel"], ORDER, [1, 2, 4]), "split", "fuel"), f"""{EVENTS}, b AS (SELECT household_id, split, fuel, value, {_lags}, count(*) OVER (PARTITION BY household_id, split, fuel) AS n FROM readings WINDOW w AS (PARTITION BY household_id, split, fuel ORDER BY ts, event_id)), a AS ({_ACF})
 SELECT split, fuel, lag, avg(acf) AS mean, stddev_pop(acf) AS sd, count(acf) AS n FROM a WHERE acf IS NOT NULL GROUP BY 1, 2, 3""", "mean sd")
_RUN = f"{EVENTS}, m AS (SELECT *, value > 60 AS hit FROM readings), i AS (SELECT *, row_number() OVER w - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS g FROM m WINDOW w AS (PARTITION BY household_id, fuel ORDER BY ts, event_id)), r AS (SELECT household_id, fuel, g, count(*) AS length FROM i WHERE hit GROUP BY 1, 2, 3), hist AS (SELECT fuel, length, count(*) AS runs FROM r GROUP BY 1, 2)"
_runs = lambda s, d: stats.run_histogram(stats.runs(E(s, d), F.col("value") > 60, KEY, ORDER), "fuel")
add("run_lengths", lambda s, d: _runs(s, d), f"{_RUN} SELECT * FROM hist")
add("run_summary", lambda s, d: stats.run_summary(_runs(s, d), "fuel"), f"{_RUN} SELECT fuel, max(length) AS longest, sum(length * runs) / sum(runs) AS mean_length, sum(runs)::BIGINT AS runs FROM hist GROUP BY fuel", "mean_length")
add("missing_stats", lambda s, d: stats.missing_stats(L(s, d).withColumn("value", F.when(F.col("tax") != 0, F.col("zero_value"))), "split", "fuel"), f"""{LINES}, h AS (SELECT household_id, split, fuel, count(*) AS n, count_if(tax <> 0) AS k, count_if(tax <> 0 AND zero_value = 0) AS z FROM readings GROUP BY 1, 2, 3)
 SELECT split, fuel, sum(n)::BIGINT AS n, 100.0 * sum(n - k) / sum(n) AS missing_pct, 100.0 * sum(z) / sum(n) AS zero_pct, 100.0 * count_if(k = 0) / count(*) AS empty_pct FROM h GROUP BY 1, 2""", "missing_pct zero_pct empty_pct")
_WK = f"{EVENTS}, w0 AS (SELECT *, (row_number() OVER (PARTITION BY household_id ORDER BY ts, event_id) - 1) // 16 + 1 AS week FROM readings), w AS (SELECT * FROM w0 WHERE week <= 4)"
_weeks = lambda s, d: stats.week_of_series(E(s, d), ["household_id"], ORDER, 16)
add("weekly_fidelity", lambda s, d: stats.weekly_fidelity(_weeks(s, d), "split"), f"""{_WK}, s AS (SELECT split, week, count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, stddev_pop(value) / sqrt(count(value)) AS se, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90 FROM w GROUP BY 1, 2)
 SELECT s.*, s.mean / o.mean AS to_week1 FROM s JOIN s o ON s.split = o.split AND o.week = 1""", "mean sd se p10 p25 p50 p75 p90 to_week1")
_SHAPE = f"""{_WK}, p AS (SELECT split, week, half_hour, avg(value) AS m FROM w GROUP BY 1, 2, 3), j AS (SELECT p.*, o.m AS m1 FROM p LEFT JOIN p o ON o.week = 1 AND o.split = p.split AND o.half_hour = p.half_hour),
 shape AS (SELECT split, week, count(m) AS points, avg(m) AS mean, stddev_pop(m) / avg(m) AS cv, CASE WHEN min(m) > 0 THEN max(m) / min(m) END AS peak_trough, CASE WHEN count_if(m1 IS NOT NULL) > 2 THEN covar_pop(m, m1) / nullif(stddev_pop(CASE WHEN m1 IS NOT NULL THEN m END) * stddev_pop(m1), 0) END AS corr_week1 FROM j GROUP BY 1, 2)"""
add("weekly_shape", lambda s, d: stats.weekly_shape(_weeks(s, d), "split"), f"{_SHAPE} SELECT * FROM shape", "mean cv peak_trough corr_week1")
add("first_degraded_week", lambda s, d: stats.first_degraded(stats.weekly_shape(_weeks(s, d), "split"), "split"), f"{_SHAPE} SELECT s.split, min(CASE WHEN s.corr_week1 < 0.7 THEN s.week END)::INTEGER AS corr_week, min(CASE WHEN s.cv / o.cv < 0.5 THEN s.week END)::INTEGER AS cv_week FROM shape s JOIN shape o ON o.split = s.split AND o.week = 1 GROUP BY s.split")
_prof = lambda s, d: stats.monthly_profile(E(s, d), "split", "fuel")
_MP = f"{EVENTS}, p AS (SELECT split, fuel, month, half_hour, count(value) AS n, avg(value) AS mean, CASE WHEN count(value) > 1 THEN stddev_pop(value) / sqrt(count(value)) ELSE 0.0 END AS se FROM readings GROUP BY 1, 2, 3, 4)"
add("monthly_profile", lambda s, d: _prof(s, d), f"{_MP} SELECT * FROM p", "mean se")
add("pattern_metrics", lambda s, d: stats.pattern_metrics(_prof(s, d), "split", "fuel", "month"), f"""{_MP} SELECT split, fuel, month, max(mean) AS peak, (arg_max(half_hour, (mean, -half_hour))) AS peak_half_hour, min(mean) AS trough, arg_min(half_hour, (mean, half_hour)) AS trough_half_hour, CASE WHEN min(mean) > 0 THEN max(mean) / min(mean) END AS peak_trough, stddev_pop(mean) / avg(mean) AS cv FROM p GROUP BY 1, 2, 3""", "peak trough peak_trough cv")
add("profile_heatmap", lambda s, d: stats.heatmap(_prof(s, d).where("split = 'train'"), "fuel").select("fuel", "month", *[F.round(F.col(str(i)), 6).alias(f"h{i}") for i in range(1, 49)]), f"{_MP} SELECT fuel, month, {', '.join(f'round(max(CASE WHEN half_hour = {i} THEN mean END), 6) AS h{i}' for i in range(1, 49))} FROM p WHERE split = 'train' GROUP BY 1, 2")
add("profile_rmse", lambda s, d: stats.profile_rmse(_prof(s, d).where("split = 'synth'"), _prof(s, d).where("split = 'train'"), ["fuel"]), f"{_MP} SELECT a.fuel, sqrt(avg(pow(a.mean - b.mean, 2))) AS rmse, count(*) AS points FROM p a JOIN p b ON a.fuel = b.fuel AND a.half_hour = b.half_hour WHERE a.split = 'synth' AND b.split = 'train' GROUP BY 1", "rmse")
add("profile_grid", lambda s, d: stats.on_grid(_prof(s, d).where("split = 'val'").select("fuel", "month", "half_hour", "mean"), _prof(s, d).select("fuel"), month=(1, 2), half_hour=(1, 48)), f"{_MP} SELECT f.fuel, m.month::INTEGER AS month, h.half_hour::INTEGER AS half_hour, p.mean FROM (SELECT DISTINCT fuel FROM p) f, range(1, 3) m(month), range(1, 49) h(half_hour) LEFT JOIN p ON p.split = 'val' AND p.fuel = f.fuel AND p.month = m.month AND p.half_hour = h.half_hour", "mean")
_PTG = f"{LINES}, p AS (SELECT split, fuel, month, sum(value) / count(value) AS consumption, sum(tax) / count(tax) AS temperature FROM readings GROUP BY 1, 2, 3 HAVING count(value) > 0 AND count(tax) > 0)"
_ptg = lambda s, d: stats.ptg(L(s, d), "split", "fuel", temp="tax")
add("ptg_monthly", lambda s, d: _ptg(s, d), f"{_PTG} SELECT * FROM p", "consumption temperature")
add("ptg_slope", lambda s, d: stats.ptg_slope(_ptg(s, d), "split", "fuel"), f"{_PTG} SELECT split, fuel, CASE WHEN count(*) >= 3 THEN covar_pop(temperature, consumption) / nullif(var_pop(temperature), 0) END AS slope, count(*) AS months FROM p GROUP BY 1, 2", "slope", 3)
add("ptg_lines", lambda s, d: stats.ptg_lines(_ptg(s, d), 0.04, "split", "fuel"), f"""{_PTG} SELECT split, fuel, CASE WHEN temperature <= 0.04 THEN 'heating' ELSE 'base' END AS side, count(*) AS months, covar_pop(temperature, consumption) / nullif(var_pop(temperature), 0) AS slope,
 avg(consumption) - covar_pop(temperature, consumption) / nullif(var_pop(temperature), 0) * avg(temperature) AS intercept FROM p GROUP BY 1, 2, 3 HAVING count(*) >= 2""", "slope intercept", 2)
add("calendar_tokens", lambda s, d: vocab.calendar_tokens(E(s, d).select("event_id", "ts")).select("event_id", "hh", "dow", "month"), f"{EVENTS} SELECT event_id, half_hour AS hh, dow, month FROM readings")
add("half_hour_resample", lambda s, d: resample(E(s, d)).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm")), f"{EVENTS} SELECT household_id, fuel, strftime(time_bucket(INTERVAL '30 minutes', ts), '%Y-%m-%d %H:%M') AS start, sum(value) AS total, count(value) AS n FROM readings GROUP BY 1, 2, 3", "total")
_by_split = lambda s, d: E(s, d).groupBy(F.col("split").alias("household_id"), F.when(F.col("fuel") == "click", "electricity").otherwise("gas").alias("fuel"), "half_hour").agg(F.avg("value").alias("value"))
add("wide_months", lambda s, d: wide_month(_by_split(s, d), ["synth", "train", "val", "test"], ["half_hour"]).select("half_hour", *[F.round(F.col(f"{h}_{n}"), 6).alias(f"{h}_{n}") for h in ("synth", "train", "val", "test") for n in ("elec_net_Wh", "gas_Wh")]),
    f"{EVENTS} SELECT half_hour, " + ", ".join(f"round(avg(CASE WHEN split = '{h}' AND fuel {o} 'click' THEN value END), 6) AS \"{h}_{n}\"" for h in ("synth", "train", "val", "test") for n, o in (("elec_net_Wh", "="), ("gas_Wh", "<>"))) + " FROM readings GROUP BY 1")
add("wide_to_long", lambda s, d: wide_to_long(wide_month(_by_split(s, d), ["synth", "train", "val", "test"], ["half_hour"]), ["half_hour"]).where("value IS NOT NULL"),
    f"{EVENTS} SELECT half_hour, split AS household_id, CASE fuel WHEN 'click' THEN 'electricity' ELSE 'gas' END AS fuel, avg(value) AS value FROM readings GROUP BY 1, 2, 3", "value")

# vocabularies and tokens
_HIST = f"{EVENTS}, hist AS (SELECT fuel, round_even(value, 1) AS v, count(*) AS n FROM readings WHERE value IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(n) OVER (PARTITION BY fuel ORDER BY v) AS cdf, sum(n) OVER (PARTITION BY fuel) AS total FROM hist)"
_hist = lambda s, d: vocab.histogram(E(s, d), "value", ("fuel",))
add("value_histogram", lambda s, d: _hist(s, d), f"{_HIST} SELECT fuel, v, n FROM hist", "v", 1)
_QB = f"{_HIST}, b AS (SELECT c.fuel, i.i::INTEGER AS i, min(v) AS boundary FROM c, range(1, 16) i(i) WHERE cdf * 16 >= i.i * total GROUP BY 1, 2)"
add("quantile_boundaries", lambda s, d: vocab.quantile_boundaries(_hist(s, d), 16, ("fuel",)), f"{_QB} SELECT * FROM b", "boundary", 1)
_UB = f"{_HIST}, hi AS (SELECT fuel, min(CASE WHEN cdf >= total * 99.5 / 100 THEN v END) AS hi FROM c GROUP BY 1), b AS (SELECT fuel, i.i::INTEGER AS i, hi / 16 * i.i AS boundary FROM hi, range(1, 16) i(i))"
add("uniform_boundaries", lambda s, d: vocab.uniform_boundaries(_hist(s, d), 16, by=("fuel",)), f"{_UB} SELECT * FROM b", "boundary")
_LISTS = ", lists AS (SELECT fuel, list(boundary ORDER BY i) AS boundaries FROM b GROUP BY 1)"
_TOK = f"{_QB}{_LISTS}, t AS (SELECT r.*, len(list_filter(boundaries, lambda x: x < round_even(value, 1)))::INTEGER AS token FROM readings r JOIN lists USING (fuel))"


def _tokens(s: SparkSession, d: str) -> DataFrame:
    lists = vocab.boundary_lists(vocab.quantile_boundaries(_hist(s, d), 16, ("fuel",)), ("fuel",))
    return E(s, d).join(F.broadcast(lists), "fuel").withColumn("token", vocab.encode(F.col("value"), F.col("boundaries")))


add("encode", lambda s, d: _tokens(s, d).select("event_id", "token"), f"{_TOK} SELECT event_id, token FROM t")
add("bin_means", lambda s, d: vocab.bin_means(_hist(s, d), vocab.boundary_lists(vocab.quantile_boundaries(_hist(s, d), 16, ("fuel",)), ("fuel",)), ("fuel",)).select("fuel", F.posexplode("bin_means").alias("k", "mean")), f"""{_QB}{_LISTS}, k AS (SELECT fuel, len(list_filter(boundaries, lambda x: x < v))::INTEGER AS k, sum(v * n) / sum(n) AS m FROM hist JOIN lists USING (fuel) GROUP BY 1, 2), grid AS (SELECT fuel, boundaries, unnest(range(0, 16))::INTEGER AS k FROM lists)
 SELECT fuel, k, coalesce(m, CASE WHEN k <= 0 THEN boundaries[1] WHEN k >= 15 THEN boundaries[15] ELSE (boundaries[k] + boundaries[k + 1]) / 2 END) AS mean FROM grid LEFT JOIN k USING (fuel, k)""", "mean")
add("decode", lambda s, d: _tokens(s, d).select("event_id", vocab.decode(F.col("token"), F.col("boundaries")).alias("value")), f"{_TOK} SELECT event_id, CASE WHEN token <= 0 THEN boundaries[1] WHEN token >= 15 THEN boundaries[15] ELSE (boundaries[token] + boundaries[token + 1]) / 2 END AS value FROM t JOIN lists USING (fuel)", "value", 4)


def _zero_tokens(s: SparkSession, d: str) -> DataFrame:
    edges = F.array(*[F.lit(x / 100) for x in (2, 4, 6, 8)])
    return L(s, d).groupBy(vocab.encode(F.col("zero_value") * 10, F.transform(edges, lambda e: e * 10), True).alias("token")).agg(F.count(F.lit(1)).alias("n"))


add("zero_aware_tokens", _zero_tokens, f"{LINES} SELECT CASE WHEN round_even(zero_value * 10, 1) = 0 THEN 0 ELSE len(list_filter([0.02 * 10, 0.04 * 10, 0.06 * 10, 0.08 * 10]::DOUBLE[], lambda x: x < round_even(zero_value * 10, 1))) + 1 END::INTEGER AS token, count(*) AS n FROM readings GROUP BY 1")
add("category_tokens", lambda s, d: vocab.encode_category(H(s, d), vocab.categories(H(s, d), "segment"), "segment").groupBy("segment", "segment_token").agg(F.count(F.lit(1)).alias("n")), f"WITH {HOMES} SELECT segment, (dense_rank() OVER (ORDER BY segment) - 1)::INTEGER AS segment_token, count(*) AS n FROM homes GROUP BY segment")
_EDGES = "[0.0, 20.0, 40.0, 60.0, 80.0, 100.0, 500.0]"
add("evaluation_bins", lambda s, d: E(s, d).select("event_id", vocab.bin_right(F.col("value"), F.array(*[F.lit(float(x)) for x in (0, 20, 40, 60, 80, 100, 500)])).alias("rule_a"), vocab.bin_inner(F.col("value"), F.array(*[F.lit(float(x)) for x in (0, 20, 40, 60, 80, 100, 500)])).alias("rule_b")),
    f"SELECT event_id, greatest(0, len(list_filter({_EDGES}::DOUBLE[], lambda e: e <= value)) - 1)::INTEGER AS rule_a, len(list_filter(({_EDGES}::DOUBLE[])[2:6], lambda e: e <= value))::INTEGER AS rule_b FROM events")
add("equal_width_histogram", lambda s, d: vocab.equal_width(E(s, d), "value", 0.0, 200.0, 50, ("fuel",)), f"{EVENTS}, b AS (SELECT fuel, least(floor(value / 4.0) + 1, 50)::INTEGER AS bin, count(*) AS n FROM readings WHERE value BETWEEN 0 AND 200 GROUP BY 1, 2) SELECT *, n / (sum(n) OVER (PARTITION BY fuel) * 4.0) AS density FROM b", "density")
_FREQ = f"{_TOK}, cnt AS (SELECT split, token, count(*) AS n FROM t GROUP BY 1, 2), f AS (SELECT g.split, g.token, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.split) AS f FROM (SELECT DISTINCT split, unnest(range(0, 16))::INTEGER AS token FROM cnt) g LEFT JOIN cnt USING (split, token))"
_freq = lambda s, d: compare.token_counts(_tokens(s, d), F.col("token"), 16, "split")
add("token_frequency", lambda s, d: _freq(s, d), f"{_FREQ} SELECT * FROM f", "f")
add("token_summary", lambda s, d: compare.token_summary(_freq(s, d), 16, "split"), f"""{_FREQ} SELECT split, sum(n)::BIGINT AS n, -sum(CASE WHEN f > 0 THEN f * log2(f) ELSE 0 END) AS entropy, 4.0 AS max_entropy, stddev_pop(f) AS sd, max(abs(f - 0.0625)) AS max_deviation, sum(CASE WHEN token < 8 THEN f ELSE 0 END) AS lower_half, sum(CASE WHEN token >= 8 THEN f ELSE 0 END) AS upper_half,
 sum(CASE WHEN token < 5 THEN f ELSE 0 END) AS lower_third, sum(CASE WHEN token >= 5 AND token < 10 THEN f ELSE 0 END) AS middle_third, sum(CASE WHEN token >= 10 THEN f ELSE 0 END) AS upper_third, sum(f * token) AS mean_token FROM f GROUP BY split""", "entropy max_entropy sd max_deviation lower_half upper_half lower_third middle_third upper_third mean_token")
_one = lambda s, d, x: _freq(s, d).where(F.col("split") == x).drop("split")
add("cdf_gap", lambda s, d: compare.cdf_gap(_one(s, d, "synth"), _one(s, d, "train")), f"""{_FREQ}, k AS (SELECT split, token, sum(f) OVER (PARTITION BY split ORDER BY token) AS cdf FROM f), g AS (SELECT a.token, a.cdf - b.cdf AS gap FROM k a JOIN k b USING (token) WHERE a.split = 'synth' AND b.split = 'train')
 SELECT max(abs(gap)) AS max_gap, arg_max(gap, (abs(gap), -token)) AS signed_gap, arg_max(token, (abs(gap), -token)) AS token FROM g""", "max_gap signed_gap")
_wf = lambda s, d: compare.token_counts(stats.week_of_series(_tokens(s, d), ["household_id"], ORDER, 16).where("split = 'synth'"), F.col("token"), 16, "week")
_WF = f"{_FREQ}, wk AS (SELECT *, ((row_number() OVER (PARTITION BY household_id ORDER BY ts, event_id) - 1) // 16 + 1)::INTEGER AS week FROM t), wc AS (SELECT week, token, count(*) AS n FROM wk WHERE week <= 4 AND split = 'synth' GROUP BY 1, 2), wf AS (SELECT g.week, g.token, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY g.week) AS f FROM (SELECT DISTINCT week, unnest(range(0, 16))::INTEGER AS token FROM wc) g LEFT JOIN wc USING (week, token))"
add("weekly_token_frequency", lambda s, d: _wf(s, d), f"{_WF} SELECT * FROM wf", "f")
add("drift_mechanisms", lambda s, d: compare.mechanisms(_one(s, d, "train"), _wf(s, d)), f"""{_WF}, j AS (SELECT w.week, sum(abs(o.f - r.f)) AS learning, sum(abs(w.f - o.f)) AS drift FROM wf w JOIN wf o ON o.week = 1 AND o.token = w.token JOIN f r ON r.split = 'train' AND r.token = w.token WHERE w.week > 1 GROUP BY 1)
 SELECT week, learning, drift, 100 * drift / (drift + learning) AS drift_pct FROM j""", "learning drift drift_pct")
_tt = lambda s, d: compare.token_table(_one(s, d, "synth"), _one(s, d, "train"), s.range(16).select(F.col("id").cast("int").alias("token"), (F.col("id") * 10).cast("double").alias("lower"), (F.col("id") * 10 + 10).cast("double").alias("upper")))
_TT = f"{_FREQ}, tt AS (SELECT a.token, a.token * 10.0::DOUBLE AS lower, a.token * 10.0::DOUBLE + 10 AS upper, 10.0::DOUBLE AS width, a.token * 10.0::DOUBLE + 5 AS centre, a.n AS n_synth, b.n AS n_real, a.f AS f_synth, b.f AS f_real, a.f - b.f AS diff FROM f a JOIN f b USING (token) WHERE a.split = 'synth' AND b.split = 'train')"
add("token_table", lambda s, d: _tt(s, d), f"{_TT} SELECT * FROM tt", "lower upper width centre f_synth f_real diff")
add("most_different_tokens", lambda s, d: compare.most_different(_tt(s, d)).select("token", "diff", "side"), f"{_TT} (SELECT token, diff, 'over' AS side FROM tt ORDER BY diff DESC, token LIMIT 5) UNION ALL (SELECT token, diff, 'under' FROM tt ORDER BY diff, token LIMIT 5)", "diff")
add("frequency_finding", lambda s, d: compare.frequency_finding(compare.token_summary(_one(s, d, "synth"), 16), compare.token_summary(_one(s, d, "train"), 16)), f"""{_FREQ}, x AS (SELECT split, sum(CASE WHEN token < 8 THEN f ELSE 0 END) AS h, sum(f * token) AS m FROM f GROUP BY 1)
 SELECT a.h - b.h AS lower_half_shift, a.m AS mean_synth, b.m AS mean_real, CASE WHEN a.h - b.h > 0.005 THEN 'shifted to low tokens' WHEN a.h - b.h < -0.005 THEN 'shifted to high tokens' ELSE 'balanced' END AS finding FROM x a, x b WHERE a.split = 'synth' AND b.split = 'train'""", "lower_half_shift mean_synth mean_real")
_VS = "count(value) AS n, avg(value) AS mean, stddev_pop(value) AS sd, sum(pow(value - mu, 3)) / count(value) / nullif(pow(stddev_pop(value), 3), 0) AS skew, count_if(value = 0) / count(value) AS zero_rate, quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, median(value) AS median, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.9) AS p90, quantile_cont(value, 0.99) AS p99, avg(value) / nullif(median(value), 0) AS mean_to_median"
add("value_statistics", lambda s, d: compare.value_statistics(E(s, d), "split"), f"{EVENTS}, c AS (SELECT *, avg(value) OVER (PARTITION BY split) AS mu FROM readings) SELECT split, {_VS} FROM c GROUP BY split", "mean sd skew zero_rate p10 p25 median p75 p90 p99 mean_to_median", 4)
_vs = lambda s, d, x: compare.value_statistics(E(s, d).where(F.col("split") == x))
add("median_bias", lambda s, d: compare.median_bias(_vs(s, d, "synth"), _vs(s, d, "train")), f"{EVENTS} SELECT a.m AS synth_mean, b.m AS real_mean, b.md AS real_median, abs(a.m - b.md) < abs(a.m - b.m) AS median_biased, 100 * (a.m - b.m) / b.m AS bias_pct FROM (SELECT avg(value) AS m FROM readings WHERE split = 'synth') a, (SELECT avg(value) AS m, median(value) AS md FROM readings WHERE split = 'train') b", "synth_mean real_mean real_median bias_pct")
add("below_range", lambda s, d: compare.below_range(E(s, d), 1.0, "fuel"), f"{EVENTS} SELECT fuel, avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END) AS share, avg(CASE WHEN value < 1 THEN 1.0 ELSE 0.0 END) > 0.01 AS reported FROM readings GROUP BY fuel", "share")

# comparison of splits
_two = lambda s, d, x: E(s, d).where(F.col("split") == x)
_WKS = f"""{EVENTS}, v AS (SELECT fuel, value AS v, count_if(split = 'synth') AS a, count_if(split = 'train') AS b FROM readings WHERE split IN ('synth', 'train') GROUP BY 1, 2),
 k AS (SELECT fuel, v, sum(a) OVER w / sum(a) OVER (PARTITION BY fuel) AS fa, sum(b) OVER w / sum(b) OVER (PARTITION BY fuel) AS fb, lead(v) OVER w AS nx, sum(a) OVER (PARTITION BY fuel) AS na, sum(b) OVER (PARTITION BY fuel) AS nb FROM v WINDOW w AS (PARTITION BY fuel ORDER BY v))"""
add("wasserstein_ks", lambda s, d: compare.normalised(compare.distances(_two(s, d, "synth"), _two(s, d, "train"), ["fuel"]), _two(s, d, "train"), ["fuel"]), f"""{_WKS} SELECT k.fuel, sum(abs(fa - fb) * (nx - v)) AS wasserstein, max(abs(fa - fb)) AS ks, max(na)::BIGINT AS n_a, max(nb)::BIGINT AS n_b, sum(abs(fa - fb) * (nx - v)) / max(s.sd) AS wasserstein_norm FROM k JOIN (SELECT fuel, stddev_pop(value) AS sd FROM readings WHERE split = 'train' GROUP BY 1) s USING (fuel) GROUP BY 1""", "wasserstein ks wasserstein_norm")
add("ks_grades", lambda s, d: compare.distances(_two(s, d, "synth"), _two(s, d, "train"), ["fuel"]).withColumn("p", compare.ks_p(F.col("ks"), F.col("n_a"), F.col("n_b"))).select("fuel", "ks", "p", compare.ks_status(F.col("p")).alias("status")), f"""{_WKS}, g AS (SELECT fuel, max(abs(fa - fb)) AS ks, max(na)::DOUBLE AS n_a, max(nb)::DOUBLE AS n_b FROM k GROUP BY 1),
 l AS (SELECT fuel, ks, (sqrt(n_a * n_b / (n_a + n_b)) + 0.12 + 0.11 / sqrt(n_a * n_b / (n_a + n_b))) * ks AS lam FROM g),
 p AS (SELECT fuel, ks, CASE WHEN lam < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, (SELECT sum(CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * j * j * lam * lam)) FROM range(1, 61) t(j)))) END AS p FROM l)
 SELECT fuel, ks, p, CASE WHEN p > 0.05 THEN 'pass' WHEN p > 0.01 THEN 'warn' ELSE 'fail' END AS status FROM p""", "ks p")
_pairs = [("value", "price"), ("price", "tax"), ("value", "tax")]
_GC = lambda a, b: f"CASE WHEN count({a}) >= 10 THEN covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) END"
_CORR = f"{LINES}, r AS (" + " UNION ALL ".join(f"SELECT household_id, split, month, '{a}_{b}' AS pair, {_GC(a, b)} AS r FROM readings GROUP BY 1, 2, 3" for a, b in _pairs) + ")"
add("month_correlations", lambda s, d: compare.month_correlations(L(s, d), _pairs, "household_id", "split", "month"), f"{_CORR} SELECT household_id, split, month, pair, r FROM r WHERE r IS NOT NULL", "r")
add("correlation_comparison", lambda s, d: compare.correlation_comparison(compare.month_correlations(L(s, d), _pairs, "household_id", "split", "month")), f"""{_CORR}, s AS (SELECT pair, split, avg(r) AS mean, stddev_pop(r) AS sd, count(r) AS n FROM r WHERE r IS NOT NULL GROUP BY 1, 2)
 SELECT s.pair, s.split, s.mean, s.sd, s.n, o.mean - s.mean AS diff, CASE WHEN s.split = 'train' THEN CASE WHEN abs(o.mean - s.mean) >= 0.2 THEN 'fail' WHEN abs(o.mean - s.mean) >= 0.1 THEN 'warn' ELSE 'pass' END END AS status FROM s JOIN s o ON o.pair = s.pair AND o.split = 'synth' WHERE s.split <> 'synth'""", "mean sd diff")
_feat = lambda s, d: features.household_month_features(E(s, d), ["split", "household_id", "month"], ORDER, 12)
_BIN = ", ".join(f"avg(CASE WHEN half_hour - 1 >= {2 * a} AND half_hour - 1 < {2 * b} THEN m END) AS {n}_avg" for n, (a, b) in features.TIME_BINS.items())
_FEAT = f"""{EVENTS}, k AS (SELECT split, household_id, month, count(value) AS n_values, avg(value) AS mean, stddev_samp(value) AS std, max(value) AS max, min(value) AS min, skewness(value) AS skew, kurtosis(value) AS kurtosis, {", ".join(f"quantile_cont(value, {q / 100}) AS q{q}" for q in features.QUANTILES)},
 avg(CASE WHEN dow < 5 THEN value END) AS wd, avg(CASE WHEN dow >= 5 THEN value END) AS we, 100.0 * count_if(value IS NULL) / count(*) AS missing_pct, 100.0 * count_if(value = 0) / count(*) AS zeros_pct FROM readings GROUP BY 1, 2, 3),
 s AS (SELECT split, household_id, month, half_hour, avg(value) AS m FROM readings GROUP BY 1, 2, 3, 4), ti AS (SELECT split, household_id, month, arg_max((half_hour - 1) // 2, (m, -half_hour))::INTEGER AS peak_hour, {_BIN} FROM s GROUP BY 1, 2, 3),
 d0 AS (SELECT *, value - lag(value) OVER w AS diff, stddev_samp(value) OVER (w ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS vol, row_number() OVER w AS rn FROM readings WINDOW w AS (PARTITION BY split, household_id, month ORDER BY ts, event_id)),
 dd AS (SELECT split, household_id, month, avg(diff) AS first_diff_mean, stddev_samp(diff) AS first_diff_std, avg(CASE WHEN rn >= 12 THEN vol END) AS rolling_volatility_mean, stddev_samp(CASE WHEN rn >= 12 THEN vol END) AS rolling_volatility_std FROM d0 GROUP BY 1, 2, 3)"""
_cols = ", ".join(["n_values", *[c for c in features.FEATURES if c not in ("load_factor", "weekday_weekend_ratio")]])
add("household_month_features", _feat, f"{_FEAT} SELECT split, household_id, month, {_cols}, CASE WHEN max > 0 THEN mean / max END AS load_factor, CASE WHEN we > 0 THEN wd / we END AS weekday_weekend_ratio FROM k JOIN ti USING (split, household_id, month) JOIN dd USING (split, household_id, month)", " ".join(c for c in features.FEATURES if c != "peak_hour"), 9)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.when(F.col("vec_id") % 3 == 0, "synth").when(F.col("vec_id") % 3 == 1, "train").otherwise("test").alias("g"))


_V = "WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS x, CASE vec_id % 3 WHEN 0 THEN 'synth' WHEN 1 THEN 'train' ELSE 'test' END AS g FROM embeddings)"
_group = lambda s, d, g: _vectors(s, d).where(F.col("g") == g).select("id", "x")
_dist = lambda s, d, g: pairs.Pairs(_group(s, d, "synth"), _group(s, d, g))
_DIST = f"{_V}, d AS (SELECT a.id AS a_id, b.id AS b_id, b.g, list_distance(a.x, b.x) AS distance FROM v a, v b WHERE a.g = 'synth' AND b.g <> 'synth')"
add("cross_distances", lambda s, d: _dist(s, d, "train").summary().withColumn("g", F.lit("train")).unionByName(_dist(s, d, "test").summary().withColumn("g", F.lit("test"))), f"""{_DIST} SELECT g, count(*) AS n, avg(distance) AS mean, stddev_pop(distance) AS sd, min(distance) AS least, quantile_cont(distance, 0.25) AS q25, median(distance) AS median, quantile_cont(distance, 0.75) AS q75, max(distance) AS most,
 quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25) AS iqr FROM d GROUP BY g""", "mean sd least q25 median q75 most iqr")
add("within_distances", lambda s, d: pairs.Pairs(_group(s, d, "train")).summary(), f"{_V}, d AS (SELECT list_distance(a.x, b.x) AS distance FROM v a, v b WHERE a.g = 'train' AND b.g = 'train' AND a.id < b.id) SELECT count(*) AS n, avg(distance) AS mean, stddev_pop(distance) AS sd, min(distance) AS least, quantile_cont(distance, 0.25) AS q25, median(distance) AS median, quantile_cont(distance, 0.75) AS q75, max(distance) AS most, quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25) AS iqr FROM d", "mean sd least q25 median q75 most iqr")
_LEAK = f"{_DIST}, r AS (SELECT a_id AS id, avg(CASE WHEN g = 'train' THEN distance END) AS mean_train, avg(CASE WHEN g = 'test' THEN distance END) AS mean_test, min(CASE WHEN g = 'train' THEN distance END) AS least_train, min(CASE WHEN g = 'test' THEN distance END) AS least_test FROM d GROUP BY 1)"
_leak = lambda s, d: features.privacy_leakage(_group(s, d, "synth"), _group(s, d, "train"), _group(s, d, "test"))
add("privacy_leakage", _leak, f"{_LEAK} SELECT *, mean_train - mean_test AS diff, least_train < least_test AS nearer_train, least_train < (SELECT quantile_cont(least_train, 0.25) FROM r) AS high_risk FROM r", "mean_train mean_test least_train least_test diff")
add("paired_share", lambda s, d: features.paired_share(_leak(s, d)), f"{_LEAK} SELECT avg(CASE WHEN mean_train > mean_test THEN 1.0 ELSE 0.0 END) AS above, avg(CASE WHEN mean_train < mean_test THEN 1.0 ELSE 0.0 END) AS below FROM r", "above below")
_OUT = f"{_DIST}, t AS (SELECT * FROM d WHERE g = 'train'), m AS (SELECT a_id, avg(distance) AS mean FROM t GROUP BY 1)"
add("distance_outliers", lambda s, d: features.outliers(_dist(s, d, "train")).withColumnRenamed("id", "a_id"), f"{_OUT} SELECT m.a_id, m.mean, 100.0 * (SELECT count(*) FROM t WHERE t.distance < m.mean) / (SELECT count(*) FROM t) AS percentile, m.mean > (SELECT quantile_cont(distance, 0.95) FROM t) AS outlier FROM m", "mean percentile")
add("distance_report", lambda s, d: features.distance_report(_leak(s, d), features.outlier_flags(_dist(s, d, "train"))), f"""{_LEAK}, t AS (SELECT * FROM d WHERE g = 'train'), m AS (SELECT a_id, avg(distance) AS mean FROM t GROUP BY 1), c AS (SELECT quantile_cont(least_train, 0.25) AS c FROM r)
 SELECT count(*) AS rows, count_if(least_train < c) AS high_risk, count_if(least_train < least_test) AS nearer_train, (SELECT count_if(mean > (SELECT quantile_cont(distance, 0.95) FROM t)) FROM m) AS outliers FROM r, c""")
add("memorisation", lambda s, d: s.createDataFrame([features.memorisation(_leak(s, d))], "n long, mean_diff double, t double, p double, cohens_d double, memorised boolean"))
add("memorisation_effect", lambda s, d: s.createDataFrame([features.memorisation(_leak(s, d))], "n long, mean_diff double, t double, p double, cohens_d double, memorised boolean").drop("p", "memorised"), f"""{_LEAK}
 SELECT count(*) AS n, avg(mean_train - mean_test) AS mean_diff, avg(mean_train - mean_test) / (stddev_samp(mean_train - mean_test) / sqrt(count(*))) AS t, avg(mean_train - mean_test) / stddev_samp(mean_train - mean_test) AS cohens_d FROM r""", "mean_diff t cohens_d")
_MD5 = "CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 16) AS UBIGINT)::HUGEINT"
_HASH = f"((one * {pairs.FACTORS[0]} + two * {pairs.FACTORS[1]}) % 18446744073709551616) // 2"
add("distance_distributions", lambda s, d: features.distance_distributions({"synth_train": _dist(s, d, "train"), "synth_test": _dist(s, d, "test"), "synth": pairs.Pairs(_group(s, d, "synth")), "train": pairs.Pairs(_group(s, d, "train"))}, 5000),
    f"""{_V}, i AS (SELECT id, x, g, {_MD5} AS m FROM v), p AS (
 SELECT 'synth_' || b.g AS type, a.id AS a, b.id AS b, list_distance(a.x, b.x) AS distance, a.m AS one, b.m AS two FROM i a, i b WHERE a.g = 'synth' AND b.g <> 'synth'
 UNION ALL SELECT a.g, a.id, b.id, list_distance(a.x, b.x), a.m, b.m FROM i a, i b WHERE a.g = b.g AND a.g <> 'test' AND a.m < b.m),
 r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {_HASH}, a, b) AS n FROM p)
 SELECT type, a, b, distance FROM r WHERE n <= 5000""", "distance")
add("pca", lambda s, d: features.pca(_vectors(s, d).select("id", "x"), ["id"])[0])
_ZC = ["mean", "std", "skew", "rolling_volatility_std"]
_z = lambda s, d: features.standardised(_feat(s, d).select("split", "household_id", "month", *_ZC), _ZC, ["split", "household_id", "month"])
_zsql = ", ".join(f"coalesce((coalesce({c}, m_{c}, 0) - avg(coalesce({c}, m_{c}, 0)) OVER ()) / nullif(stddev_pop(coalesce({c}, m_{c}, 0)) OVER (), 0), 0) AS {c}" for c in _ZC)
add("standardised_features", lambda s, d: _z(s, d).select("split", "household_id", "month", *[F.col("x")[i].alias(c) for i, c in enumerate(_ZC)]), f"{_FEAT}, f AS (SELECT * FROM k JOIN dd USING (split, household_id, month)), g AS (SELECT *, {', '.join(f'avg({c}) OVER () AS m_{c}' for c in _ZC)} FROM f) SELECT split, household_id, month, {_zsql} FROM g", " ".join(_ZC), 4)

# within batches
_STEP = f"{LINES}, b AS (SELECT household_id // 10 AS batch_id, household_id, month AS step, avg(value) AS value FROM readings GROUP BY 1, 2, 3)"
_step = lambda s, d: L(s, d).groupBy(F.floor(F.col("household_id") / 10).alias("batch_id"), "household_id", F.col("month").alias("step")).agg(F.avg("value").alias("value"))
_COR = f"{_STEP}, p AS (SELECT x.batch_id, x.household_id AS ha, y.household_id AS hb, covar_pop(x.value, y.value) / nullif(stddev_pop(x.value) * stddev_pop(y.value), 0) AS r FROM b x JOIN b y ON x.batch_id = y.batch_id AND x.step = y.step AND x.household_id < y.household_id GROUP BY 1, 2, 3)"
add("batch_correlations", lambda s, d: pairs.batch_correlations(_step(s, d), ["batch_id"]), f"{_COR} SELECT batch_id, count(r) AS pairs, avg(r) AS mean_corr, max(r) AS max_corr, count_if(r > 0.95) AS high_pairs FROM p GROUP BY 1", "mean_corr max_corr")
_DIS = f"{_STEP}, sc AS (SELECT *, value / avg(abs(value)) OVER (PARTITION BY batch_id, household_id) AS v FROM b), p AS (SELECT x.batch_id, x.household_id AS ha, y.household_id AS hb, sqrt(sum(pow(x.v - y.v, 2))) AS d FROM sc x JOIN sc y ON x.batch_id = y.batch_id AND x.step = y.step AND x.household_id < y.household_id GROUP BY 1, 2, 3), m AS (SELECT batch_id, avg(d) AS md FROM p GROUP BY 1)"
add("batch_distances", lambda s, d: pairs.batch_distances(_step(s, d), ["batch_id"]), f"{_DIS} SELECT p.batch_id, avg(d) AS mean_distance, min(d) AS least_distance, count_if(d < 0.01 * md) AS near_identical FROM p JOIN m USING (batch_id) GROUP BY 1", "mean_distance least_distance")
_PEAK = f"{_STEP}, pk AS (SELECT batch_id, household_id, arg_max(step, (value, -step)) AS peak FROM b GROUP BY 1, 2), c AS (SELECT batch_id, peak, count(*) AS k FROM pk GROUP BY 1, 2)"
add("peak_diversity", lambda s, d: features.peak_diversity(_step(s, d), ["batch_id"]), f"{_PEAK} SELECT batch_id, sum(k)::BIGINT AS households, count(*) AS distinct_peaks, max(k) / sum(k) AS concentration FROM c GROUP BY 1", "concentration")


def _overfit(s: SparkSession, d: str) -> DataFrame:
    c, x, p = (f(_step(s, d), ["batch_id"]) for f in (pairs.batch_correlations, pairs.batch_distances, features.peak_diversity))
    out = c.join(x, "batch_id").join(p, "batch_id")
    return features.overfitting(out.select("batch_id", *[F.col(n).alias(f"elec_{n}") for n in ("high_pairs", "mean_corr", "near_identical", "concentration")]), ("elec",))


_OF = f"{_COR}, c1 AS (SELECT batch_id, avg(r) AS mc, count_if(r > 0.95) AS hp FROM p GROUP BY 1), {_DIS.split('GROUP BY 1, 2, 3), ', 1)[1].replace('p AS', 'p2 AS').replace('FROM p GROUP', 'FROM p2 GROUP')}, x1 AS (SELECT p2.batch_id, count_if(d < 0.01 * md) AS ni FROM p2 JOIN m USING (batch_id) GROUP BY 1), {_PEAK.split('GROUP BY 1, 2, 3), ', 1)[1]}, k1 AS (SELECT batch_id, max(k) / sum(k) AS cc FROM c GROUP BY 1), fl AS (SELECT batch_id, (hp > 0)::INTEGER + (coalesce(mc > 0.8, FALSE))::INTEGER + (ni > 0)::INTEGER + (cc > 0.7)::INTEGER AS n_flags FROM c1 JOIN x1 USING (batch_id) JOIN k1 USING (batch_id)), sv AS (SELECT *, CASE WHEN n_flags = 0 THEN 'none' WHEN n_flags <= 2 THEN 'low' WHEN n_flags <= 4 THEN 'medium' ELSE 'high' END AS severity FROM fl)"
add("overfitting_flags", lambda s, d: _overfit(s, d).select("batch_id", "n_flags", "severity"), f"{_OF} SELECT * FROM sv")
add("variance_report", lambda s, d: features.variance_report(_overfit(s, d)), f"{_OF} SELECT count(*) AS batches, count_if(severity = 'none') AS \"none\", count_if(severity = 'low') AS low, count_if(severity = 'medium') AS medium, count_if(severity = 'high') AS high, CASE WHEN count_if(severity = 'high') > 0 THEN 'fail' WHEN count_if(severity = 'medium') > 0.1 * count(*) THEN 'warn' ELSE 'pass' END AS status FROM sv")

# grading
_moments = lambda s, d: stats.by_split(stats.fuel_stats(E(s, d), "split", "fuel"), ["fuel"], ["mean", "sd"])
_FL = f"{EVENTS}, m AS (SELECT split, fuel, avg(value) AS mean FROM readings GROUP BY 1, 2), w AS (SELECT fuel, " + ", ".join(f"max(CASE WHEN split = '{x}' THEN mean END) AS {x}" for x in ("synth", "train", "val", "test")) + " FROM m GROUP BY 1), dv AS (SELECT fuel || '_mean_ratio' AS metric, synth / train AS value, abs(synth / train - 1) AS deviation, abs(train / val - 1) AS train_val, abs(train / test - 1) AS train_test, abs(val / test - 1) AS val_test, greatest(abs(train / val - 1), abs(train / test - 1), abs(val / test - 1)) AS natural_variation FROM w), fl AS (SELECT metric, CASE WHEN deviation <= natural_variation THEN 'pass' WHEN deviation <= 3 * natural_variation THEN 'warn' ELSE 'fail' END AS status, value, deviation, train_val, train_test, val_test, natural_variation FROM dv)"
_flag = lambda s, d: grade.flags_from(_moments(s, d), F.concat("fuel", F.lit("_mean_ratio")), "mean")
add("mean_flags", _flag, f"{_FL} SELECT * FROM fl", "value deviation train_val train_test val_test natural_variation")
add("verdict", lambda s, d: grade.verdict(_flag(s, d)), f"{_FL} SELECT count(*) AS metrics, count_if(status = 'pass') AS passed, count_if(status = 'warn') AS warned, count_if(status = 'fail') AS failed, CASE WHEN count_if(status = 'fail') > 0 THEN 'fail' WHEN count_if(status = 'warn') > 0 THEN 'warn' ELSE 'pass' END AS overall FROM fl")
add("fixed_ratio_status", lambda s, d: _moments(s, d).select("fuel", grade.fixed_status(F.col("sd_synth") / F.col("sd_train")).alias("status")), f"{EVENTS}, m AS (SELECT fuel, stddev_pop(CASE WHEN split = 'synth' THEN value END) / stddev_pop(CASE WHEN split = 'train' THEN value END) AS r FROM readings GROUP BY 1) SELECT fuel, CASE WHEN r BETWEEN 0.8 AND 1.2 THEN 'pass' WHEN r BETWEEN 0.5 AND 2.0 THEN 'warn' ELSE 'fail' END AS status FROM m")


def _sections(s: SparkSession, d: str) -> dict[str, DataFrame]:
    home = H(s, d).select("household_id", "segment", "region")
    return evaluate.evaluate(E(s, d).join(home, "household_id", "left"), ["segment", "region"], order=("ts", "event_id"))


_EDGES = {"click": [0.0, 50.0, 100.0, 150.0, 400.0, 1e9], "view": [0.0, 25.0, 100.0, 480.0, 490.0, 1e9]}


def _released(s: SparkSession, d: str) -> dict[str, DataFrame]:
    home = H(s, d).select("household_id", "segment", "nation")
    return evaluate.sanitised(evaluate.evaluate(E(s, d).join(home, "household_id", "left"), ["segment", "nation"], order=("ts", "event_id"), edges=_EDGES))


_REAL = "split IN ('train', 'val', 'test')"
_TEN = lambda c: f"CASE WHEN {_REAL} THEN (round_even({c} / 10.0, 0) * 10)::BIGINT ELSE {c} END"
_RH = f"{EVENTS}, {HOMES}, rh AS (SELECT r.*, segment, nation FROM readings r LEFT JOIN homes USING (household_id))"
add("sdc_totals", lambda s, d: _released(s, d)["totals"], f"{EVENTS} SELECT split, {_TEN('count(DISTINCT household_id)')} AS households, count(DISTINCT month) AS months FROM readings GROUP BY split")
add("sdc_marginal", lambda s, d: _released(s, d)["marginal_counts"], f"{EVENTS} SELECT split, fuel, {_TEN('count(value)')} AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM readings GROUP BY 1, 2", "mean sd")
add("sdc_seasonal", lambda s, d: _released(s, d)["seasonal"].select("split", "fuel", "month", "n", "mean"), f"{EVENTS}, h AS (SELECT split, fuel, household_id, month, avg(value) AS m FROM readings GROUP BY ALL) SELECT split, fuel, month, {_TEN('count(m)')} AS n, avg(m) AS mean FROM h WHERE m IS NOT NULL GROUP BY 1, 2, 3", "mean")
add("sdc_weekly", lambda s, d: _released(s, d)["weekly"].select("split", "fuel", "week", "n", "households", "mean"), f"""{EVENTS}, p AS (SELECT *, ((row_number() OVER (PARTITION BY split, household_id, month, fuel ORDER BY ts, event_id) - 1) // 336 + 1)::INTEGER AS week FROM readings)
 SELECT split, fuel, week, {_TEN('count(value)')} AS n, {_TEN('count(DISTINCT household_id)')} AS households, avg(value) AS mean FROM p WHERE week <= 4 GROUP BY 1, 2, 3""", "mean")
add("sdc_conditional", lambda s, d: _released(s, d)["conditional"], f"""{_RH}, c AS (SELECT cond_var, cond_value, split, fuel, avg(value) AS mean, stddev_pop(value) AS sd, count(DISTINCT household_id) AS households FROM (SELECT *, u['v'] AS cond_var, u['x'] AS cond_value FROM (SELECT split, fuel, household_id, value, unnest([{{'v': 'segment', 'x': segment::VARCHAR}}, {{'v': 'nation', 'x': nation::VARCHAR}}]) AS u FROM rh)) WHERE cond_value IS NOT NULL GROUP BY 1, 2, 3, 4),
 f AS (SELECT *, bool_or({_REAL} AND households BETWEEN 1 AND 9) OVER (PARTITION BY cond_var, cond_value) AS suppressed FROM c)
 SELECT cond_var, cond_value, split, fuel, CASE WHEN NOT suppressed THEN mean END AS mean, CASE WHEN NOT suppressed THEN sd END AS sd, CASE WHEN NOT suppressed THEN {_TEN('households')} END AS households, suppressed FROM f""", "mean sd")
add("sdc_household_months", lambda s, d: _released(s, d)["household_months"], f"""{_RH}, h AS (SELECT split, fuel, household_id, month, segment, nation, avg(value) AS m FROM rh GROUP BY ALL HAVING avg(value) IS NOT NULL),
 c AS (SELECT cond_var, cond_value, split, fuel, count(DISTINCT household_id) AS households, avg(m) AS mean, stddev_pop(m) AS sd FROM (SELECT *, u['v'] AS cond_var, u['x'] AS cond_value FROM (SELECT split, fuel, household_id, m, unnest([{{'v': 'all', 'x': 'all'}}, {{'v': 'segment', 'x': segment::VARCHAR}}, {{'v': 'nation', 'x': nation::VARCHAR}}]) AS u FROM h)) WHERE cond_value IS NOT NULL GROUP BY 1, 2, 3, 4),
 f AS (SELECT *, bool_or({_REAL} AND households BETWEEN 1 AND 9) OVER (PARTITION BY cond_var, cond_value, fuel) AS suppressed FROM c)
 SELECT cond_var, cond_value, split, fuel, CASE WHEN NOT suppressed THEN {_TEN('households')} END AS households, CASE WHEN NOT suppressed THEN mean END AS mean, CASE WHEN NOT suppressed THEN sd END AS sd, suppressed FROM f""", "mean sd")
_CUT = "CASE fuel " + " ".join(f"WHEN '{f}' THEN list_count(list_filter({cuts[1:-1]}, lambda x: x <= value))" for f, cuts in _EDGES.items()) + " END"
_wide = lambda c: ", ".join(f"max(CASE WHEN split = '{x}' THEN {c} END) AS {c}_{x}" for x in ("synth", "train", "val", "test"))
_hide = lambda c: f"CASE WHEN NOT small THEN {c} END AS {c.split('_')[0]}_{c.split('_')[1]}"
add("sdc_tokens", lambda s, d: _released(s, d)["tokens"], f"""{EVENTS}, r AS (SELECT split, fuel, {_CUT} AS token FROM readings WHERE value IS NOT NULL AND fuel IN ('click', 'view')), g AS (SELECT DISTINCT split, fuel FROM r), gt AS (SELECT split, fuel, unnest(range(5))::INTEGER AS token FROM g),
 c AS (SELECT split, fuel, gt.token, count(r.token) AS n FROM gt LEFT JOIN r USING (split, fuel, token) GROUP BY 1, 2, 3), q AS (SELECT *, n / sum(n) OVER (PARTITION BY split, fuel) AS f FROM c), x AS (SELECT *, sum(f) OVER (PARTITION BY split, fuel ORDER BY token) AS cdf FROM q),
 w AS (SELECT fuel, token, {_wide('n')}, {_wide('f')}, {_wide('cdf')} FROM x GROUP BY 1, 2), y AS (SELECT *, coalesce(n_train BETWEEN 1 AND 9, FALSE) AS small FROM w)
 SELECT fuel, token, n_synth, f_synth, cdf_synth, {', '.join(f"CASE WHEN NOT small THEN (round_even(n_{x} / 10.0, 0) * 10)::BIGINT END AS n_{x}" for x in ("train", "val", "test"))}, {', '.join(_hide(f"{v}_{x}") for v in ("f", "cdf") for x in ("train", "val", "test"))} FROM y""", " ".join(f"{v}_{x}" for v in ("f", "cdf") for x in ("synth", "train", "val", "test")))

# splits, sequences, model
_use = lambda s, d: E(s, d).groupBy("household_id").agg(F.avg("value").alias("use"))
add("energy_tiers", lambda s, d: splits.energy_tiers(_use(s, d)), f"{EVENTS}, u AS (SELECT household_id, avg(value) AS use FROM readings GROUP BY 1), q AS (SELECT quantile_cont(use, 0.33) AS a, quantile_cont(use, 0.66) AS b FROM u) SELECT household_id, use, CASE WHEN use <= a THEN 'low' WHEN use <= b THEN 'medium' ELSE 'high' END AS tier FROM u, q", "use")
add("assign_splits", lambda s, d: splits.assign_splits(H(s, d).select("household_id"), 20, 30), f"""WITH r AS (SELECT c_custkey AS household_id, row_number() OVER (ORDER BY {_rank('c_custkey')}, c_custkey) AS n FROM customer)
 SELECT household_id, CASE WHEN n <= 20 THEN 'val' WHEN n <= 50 THEN 'test' ELSE 'train' END AS split FROM r""")
_TIERS = f"""{EVENTS}, u AS (SELECT household_id, avg(value) AS use FROM readings GROUP BY 1), q AS (SELECT quantile_cont(use, 0.33) AS a, quantile_cont(use, 0.66) AS b FROM u),
 t AS (SELECT household_id, CASE WHEN use <= a THEN 'low' WHEN use <= b THEN 'medium' ELSE 'high' END AS tier FROM u, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {_rank('household_id')}, household_id) - 1 AS r, count(*) OVER (PARTITION BY tier) AS n FROM t)"""
_need = lambda size: f"CASE tier WHEN 'medium' THEN {size - 2 * (size // 3)} ELSE {size // 3} END"
_shards = lambda shards, size: f"{_TIERS}, sh AS (SELECT CAST(r // {_need(size)} AS INTEGER) AS shard, household_id, tier FROM r WHERE r // {_need(size)} < {shards})"
_redraw = lambda shards, size: f"""{_TIERS}, k AS (SELECT DISTINCT tier, n FROM r), slot AS (SELECT tier, n, unnest(range({_need(size)} * {shards})) AS slot FROM k),
 sh AS (SELECT CAST(slot // {_need(size)} AS INTEGER) AS shard, household_id, tier FROM (SELECT tier, slot, {_rank('tier', 'slot')} % n AS r FROM slot) JOIN r USING (tier, r))"""  # noqa: E731
add("training_shards", lambda s, d: splits.training_shards(splits.energy_tiers(_use(s, d)), 4, 30), f"{_shards(4, 30)} SELECT * FROM sh")
add("training_shards_redrawn", lambda s, d: splits.training_shards(splits.energy_tiers(_use(s, d)), 4, 90, replace=True), f"{_redraw(4, 90)} SELECT * FROM sh")
add("shard_sizes", lambda s, d: splits.shard_sizes(splits.training_shards(splits.energy_tiers(_use(s, d)), 40, 20)), f"{_shards(40, 20)}, z AS (SELECT shard, count(*) AS n FROM sh GROUP BY 1) SELECT min(n) AS smallest, max(n) AS largest, avg(n) AS mean, min(n) / max(n) AS balance FROM z", "mean balance")
_reservoir = lambda source, n, by, order, columns: f"SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {_rank(order)}, {order}) AS _n FROM {source}) WHERE _n <= {n}"
add("value_reservoir", lambda s, d: splits.sample_each(E(s, d), 100, ["fuel"], ["event_id"]).select("fuel", "event_id", "value"), f"{EVENTS} {_reservoir('readings', 100, 'fuel', 'event_id', 'fuel, event_id, value')}")
add("difference_reservoir", lambda s, d: splits.sample_each(stats.differences(E(s, d), KEY, ORDER).where("diff is not null"), 50, ["batch_id", "fuel"], ["event_id"]).select("batch_id", "fuel", "event_id", "diff"),
    f"""{EVENTS}, df AS (SELECT *, value - lag(value) OVER (PARTITION BY household_id, fuel ORDER BY ts, event_id) AS diff FROM readings), dn AS (SELECT * FROM df WHERE diff IS NOT NULL)
 {_reservoir('dn', 50, 'batch_id, fuel', 'event_id', 'batch_id, fuel, event_id, diff')}""", "diff")
add("template_households", lambda s, d: splits.templates(table(s, d, "orders").select(F.col("o_orderkey").alias("sample_id")), H(s, d).where("split = 'train'")), f"""WITH {HOMES}, p AS (SELECT household_id AS template_id, row_number() OVER (ORDER BY {_rank('household_id')}, household_id) - 1 AS r, count(*) OVER () AS n FROM homes WHERE split = 'train')
 SELECT o_orderkey AS sample_id, template_id FROM orders JOIN p ON r = {_rank('o_orderkey')} % n""")
add("quota_sample", lambda s, d: splits.quota_sample(H(s, d).select("household_id", "segment", "region"), {"segment": {"BUILDING": 20, "MACHINERY": 5}, "region": {"ASIA": 10}}), f"""WITH {HOMES}, r AS (SELECT household_id, segment, region, row_number() OVER (PARTITION BY segment ORDER BY {_rank('household_id')}, household_id) AS a, row_number() OVER (PARTITION BY region ORDER BY {_rank('household_id')}, household_id) AS b FROM homes)
 SELECT household_id, segment, region FROM r WHERE (segment = 'BUILDING' AND a <= 20) OR (segment = 'MACHINERY' AND a <= 5) OR (region = 'ASIA' AND b <= 10)""")
add("fixed_windows", lambda s, d: sequences.fixed_windows(_tokens(s, d).withColumn("seq", F.struct("ts", "event_id")), 12, "token", order="seq").select("household_id", "block", F.array_join("x", " ").alias("x"), F.array_join("y", " ").alias("y")), f"""{_TOK}, w AS (SELECT household_id, ts, event_id, token, lead(token) OVER (PARTITION BY household_id ORDER BY ts, event_id) AS n, ((row_number() OVER (PARTITION BY household_id ORDER BY ts, event_id) - 1) // 12)::INTEGER AS block FROM t)
 SELECT household_id, block, string_agg(token::VARCHAR, ' ' ORDER BY ts, event_id) AS x, string_agg(n::VARCHAR, ' ' ORDER BY ts, event_id) AS y FROM w WHERE n IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 12""")
add("month_windows", lambda s, d: sequences.month_windows(_tokens(s, d).withColumn("seq", F.struct("ts", "event_id")), 24, ["token", "half_hour", "dow"], ["token"], {"token": 17}, order="seq"))
_tr = lambda s, d, x: _tokens(s, d).where(F.col("split") == x).withColumn("seq", F.struct("ts", "event_id"))
_TR = f"{_TOK}, pr AS (SELECT split, dow, lag(token) OVER (PARTITION BY household_id ORDER BY ts, event_id) AS prev, token AS next FROM t), tr AS (SELECT dow, prev, next, count(*) AS n FROM pr WHERE split = 'train' AND prev IS NOT NULL GROUP BY 1, 2, 3), md AS (SELECT *, (n + 0.5) / (sum(n) OVER (PARTITION BY dow, prev) + 8) AS p, 0.5 / (sum(n) OVER (PARTITION BY dow, prev) + 8) AS po FROM tr)"
add("transition_counts", lambda s, d: sequences.transitions(_tr(s, d, "train"), ["dow"], order="seq"), f"{_TR} SELECT dow, prev, next, n FROM tr")
add("cross_entropy", lambda s, d: sequences.cross_entropy(sequences.probabilities(sequences.transitions(_tr(s, d, "train"), ["dow"], order="seq"), ["dow"], 16), _tr(s, d, "val"), ["dow"], 16, order="seq"), f"""{_TR}, h AS (SELECT dow, prev, next, count(*) AS k FROM pr WHERE split = 'val' AND prev IS NOT NULL GROUP BY 1, 2, 3), o AS (SELECT dow, prev, min(po) AS po FROM md GROUP BY 1, 2)
 SELECT sum(k)::BIGINT AS n, -sum(ln(coalesce(p, o.po, 1.0 / 16)) * k) / sum(k) AS loss FROM h LEFT JOIN md USING (dow, prev, next) LEFT JOIN o USING (dow, prev)""", "loss")
add("value_metrics", lambda s, d: sequences.value_metrics(_tokens(s, d).select("token", F.greatest(F.col("token") - 1, F.lit(0)).alias("predicted"), "value", (F.col("value") * 0.9).alias("expected"))), f"{_TOK} SELECT count(*) AS n, avg(greatest(token - 1, 0) - token) AS token_bias, avg(abs(greatest(token - 1, 0) - token)) AS token_mad, avg(abs(value * 0.9 - value)) AS mae, avg(value * 0.9) / avg(value) AS mean_ratio FROM t", "token_bias token_mad mae mean_ratio")


def _day_tokens(s: SparkSession, d: str) -> DataFrame:
    """Tokens of clicks and views as the two fuels, a row a household and day that has both; ten days stand for a month."""
    mean = lambda f: F.avg(F.when(F.col("fuel") == f, F.col("value")))
    days = E(s, d).groupBy("household_id", "split", F.dayofmonth("ts").alias("day")).agg(mean("click").alias("e"), mean("view").alias("g")).where("e is not null and g is not null")
    token = lambda c: F.least(F.floor(F.col(c) / 20), F.lit(7)).cast("int")
    return days.select("household_id", "split", F.floor((F.col("day") - 1) / 10).cast("int").alias("month"), "day", (F.col("day") % 2).alias("odd"), token("e").alias("elec"), token("g").alias("gas"), (F.col("household_id") % 6).alias("shard"))


_DAYS = f"""{EVENTS}, dy AS (SELECT household_id, split, CAST(day(ts) AS INTEGER) AS day, avg(CASE WHEN fuel = 'click' THEN value END) AS e, avg(CASE WHEN fuel = 'view' THEN value END) AS g FROM readings GROUP BY 1, 2, 3),
 tok AS (SELECT household_id, split, (day - 1) // 10 AS month, day, day % 2 AS odd, CAST(least(floor(e / 20), 7) AS INTEGER) AS elec, CAST(least(floor(g / 20), 7) AS INTEGER) AS gas, household_id % 6 AS shard FROM dy WHERE e IS NOT NULL AND g IS NOT NULL)"""
_joint = lambda s, d: generate.joint_transitions(_day_tokens(s, d).where("split = 'train'"), ["month"], ["odd"], ["household_id"], "day")
_JOINT = f"""{_DAYS}, lg AS (SELECT month, odd, elec, gas, lag(elec) OVER w AS pe, lag(gas) OVER w AS pg FROM tok WHERE split = 'train' WINDOW w AS (PARTITION BY household_id ORDER BY day)),
 jt AS (SELECT month, odd, fuel, pe AS prev_elec, pg AS prev_gas, next, count(*) AS n FROM (SELECT *, 'elec' AS fuel, elec AS next FROM lg UNION ALL SELECT *, 'gas', gas FROM lg) WHERE pe IS NOT NULL GROUP BY ALL)"""
add("joint_transitions", _joint, f"{_JOINT} SELECT * FROM jt")


def _steps(s: SparkSession, d: str) -> DataFrame:
    """Each test household's days as the steps of a sample, by month."""
    own = _day_tokens(s, d).where("split = 'test'").select(F.col("household_id").alias("sample_id"), "month", "day", "odd")
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("sample_id", "month").orderBy("day")) - 1)


def _generated(s: SparkSession, d: str) -> DataFrame:
    return generate.generate(_steps(s, d), _joint(s, d), ["month"], ["odd"], {"elec": 8, "gas": 8})


_cdf = lambda name, state: f"""{name} AS (SELECT {state}, next, (sum(k) OVER w - k) / sum(k) OVER (PARTITION BY {state}) AS lo, sum(k) OVER w / sum(k) OVER (PARTITION BY {state}) AS hi FROM
  (SELECT {state}, next, sum(n) AS k FROM own GROUP BY ALL) WINDOW w AS (PARTITION BY {state} ORDER BY next))"""  # noqa: E731
_unit = lambda fuel: f"(CAST('0x' || substr(md5(concat_ws(':', st.sample_id, st.month, st.pos, '{fuel}', 42)), 1, 12) AS BIGINT) / 281474976710656.0)"
_pick = lambda fuel, own: " ".join(
    f"LEFT JOIN {t} AS {t}_{fuel} ON {t}_{fuel}.fuel = '{fuel}' AND {t}_{fuel}.month = st.month AND {t}_{fuel}.odd = st.odd{state} AND {_unit(fuel)} >= {t}_{fuel}.lo AND {_unit(fuel)} < {t}_{fuel}.hi"
    for t, state in (("c0", f" AND c0_{fuel}.prev_elec = g.elec AND c0_{fuel}.prev_gas = g.gas"), ("c1", f" AND c1_{fuel}.own = g.{own}"), ("c2", ""))
)
_token = lambda fuel: f"CAST(coalesce(c0_{fuel}.next, c1_{fuel}.next, c2_{fuel}.next, floor({_unit(fuel)} * 8)) AS INTEGER)"
_GENERATED = f"""{_JOINT.replace('WITH ', 'WITH RECURSIVE ', 1)}, own AS (SELECT *, CASE fuel WHEN 'elec' THEN prev_elec ELSE prev_gas END AS own FROM jt WHERE next BETWEEN 0 AND 7),
 {_cdf('c0', 'month, odd, fuel, prev_elec, prev_gas')}, {_cdf('c1', 'month, odd, fuel, own')}, {_cdf('c2', 'month, odd, fuel')},
 st AS (SELECT household_id AS sample_id, month, day, odd, row_number() OVER (PARTITION BY household_id, month ORDER BY day) - 1 AS pos FROM tok WHERE split = 'test'),
 g AS (SELECT DISTINCT sample_id, month, CAST(NULL AS INTEGER) AS day, CAST(NULL AS INTEGER) AS odd, CAST(-1 AS BIGINT) AS pos, 0 AS elec, 0 AS gas FROM st
  UNION ALL SELECT st.sample_id, st.month, st.day, st.odd, st.pos, {_token('elec')}, {_token('gas')} FROM g JOIN st ON st.sample_id = g.sample_id AND st.month = g.month AND st.pos = g.pos + 1 {_pick('elec', 'elec')} {_pick('gas', 'gas')})
 SELECT sample_id, month, day, odd, CAST(pos AS INTEGER) AS pos, elec, gas FROM g WHERE pos >= 0"""
add("generated_week", _generated, _GENERATED)
_counts = lambda s, d: training.shard_transitions(_day_tokens(s, d).where("split = 'train'"), ["month"], order="day", token="elec")
_held = lambda s, d: sequences.transitions(_day_tokens(s, d).where("split = 'val'"), ["month"], token="elec", order="day")
_at = lambda keys, wanted: f"(SELECT coalesce(sum(n), 0) FROM tr t JOIN ep x USING (shard) WHERE x.epoch <= e.epoch AND {' AND '.join(f't.{k} = h.{k}' for k in keys.split())})"
_LOSSES = f"""{_DAYS}, pt AS (SELECT split, shard, month, lag(elec) OVER (PARTITION BY household_id ORDER BY day) AS prev, elec AS next FROM tok),
 tr AS (SELECT shard, month, prev, next, count(*) AS n FROM pt WHERE split = 'train' AND prev IS NOT NULL GROUP BY ALL), held AS (SELECT month, prev, next, count(*) AS k FROM pt WHERE split = 'val' AND prev IS NOT NULL GROUP BY ALL),
 ep AS (SELECT shard, row_number() OVER (ORDER BY {_rank('shard')}, shard) AS epoch FROM (SELECT DISTINCT shard FROM tr)),
 pp AS (SELECT e.epoch, e.shard, h.k, {_at('month prev next', 1)} AS n1, {_at('month prev', 1)} AS t1, {_at('prev next', 1)} AS n0, {_at('prev', 1)} AS t0 FROM ep e, held h),
 lo AS (SELECT epoch, shard, -sum(ln((n1 + 2 * ((n0 + 2 / 8) / (t0 + 2))) / (t1 + 2)) * k) / sum(k) AS loss FROM pp GROUP BY 1, 2)"""
add("training_losses", lambda s, d: training.losses(_counts(s, d), _held(s, d), ["month"], 8), f"{_LOSSES} SELECT CAST(epoch AS INTEGER) AS epoch, shard, (SELECT sum(n)::BIGINT FROM tr JOIN ep x USING (shard) WHERE x.epoch <= lo.epoch) AS n_train, loss FROM lo", "loss")
add("trained_model", lambda s, d: training.train(_counts(s, d), _held(s, d), ["month"], 8, patience=99)[0], f"""{_LOSSES}, b AS (SELECT epoch FROM lo ORDER BY round(loss, 12), epoch LIMIT 1)
 SELECT month, prev, next, sum(n)::BIGINT AS n FROM tr JOIN ep USING (shard) WHERE ep.epoch <= (SELECT epoch FROM b) GROUP BY 1, 2, 3""")
add("fixture_readings", lambda s, d: fixtures.readings(fixtures.household_ids(s, 2)))


def _fixture_catalog(s: SparkSession, d: str) -> DataFrame:
    ids = fixtures.household_ids(s, 200)
    cat = join_metadata(fixtures.survey(ids), fixtures.epc(ids), fixtures.participants(ids), fixtures.follow_up(ids), fixtures.exporters(ids))
    return filters.context_variables(filters.negative_to_null(cat, ["B1", "B4", "B5", "B9", "C1_new", "D4"]))


add("fixture_catalog", _fixture_catalog)


def _tokenised(s: SparkSession, d: str) -> DataFrame:
    """All readings; every event type is a fuel, so a household is complete if it has readings of each."""
    r = E(s, d)
    fuels = sorted(x["fuel"] for x in r.select("fuel").where("fuel is not null").distinct().collect())  # a few
    homes = r.select("household_id").distinct()
    _, out = evaluate.tokenise(r, homes, homes.where("household_id % 7 = 0").select(F.col("household_id").alias("puprn")), dict.fromkeys(fuels, 16))
    return out.groupBy("fuel", "token").agg(F.count(F.lit(1)).alias("n"))


_OWN = """, missing AS (SELECT household_id, fuel, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS m FROM readings GROUP BY 1, 2),
 kept AS (SELECT household_id FROM missing WHERE m < 0.2 AND household_id % 7 <> 0 GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT fuel) FROM readings)),
 own AS (SELECT * FROM readings WHERE household_id IN (SELECT household_id FROM kept))"""
add("tokenise_plan", _tokenised, f"""{EVENTS}{_OWN}{_TOK[len(EVENTS):].replace('FROM readings', 'FROM own')} SELECT fuel, token, count(*) AS n FROM t GROUP BY 1, 2""")


def _listed(s: SparkSession, d: str) -> DataFrame:
    """Stored readings of the households that a stored list names. They are stored in buckets of households: a folder a
    household would make as many files as there are households, whatever the cluster."""
    path = f"{shared_dir(s)}/listed-{uuid.uuid4().hex}"
    own = L(s, d).select("household_id", "fuel", "month", "value")
    readings = series_table(own, order=())
    write_household_list(own.where("household_id % 3 = 1 and month = 12").select("household_id"), f"{path}/vocabulary")
    return listed(readings, household_list(s, f"{path}/vocabulary"))[0].groupBy("household_id", "fuel").agg(F.count("value").alias("n"), F.sum("value").alias("total"))


add("listed_readings", _listed, f"{LINES} SELECT household_id, fuel, count(value) AS n, sum(value) AS total FROM readings WHERE household_id IN (SELECT household_id FROM readings WHERE household_id % 3 = 1 AND month = 12) GROUP BY 1, 2", "total")


def _feature_matrix(s: SparkSession, d: str) -> DataFrame:
    """The standardised features as NumPy shards in the shared folder, read back."""
    own, path = _z(s, d), f"{shared_dir(s)}/feature-matrix-{uuid.uuid4().hex}"
    write_matrix(own, path)
    return read_matrix(s, path, own.schema).select("split", "household_id", "month", *[F.col("x")[i].alias(c) for i, c in enumerate(_ZC)])


add("feature_matrix", _feature_matrix, SQL["standardised_features"].split(" FROM (", 1)[1][:-1], " ".join(_ZC), 4)

from . import reports  # noqa: E402, F401  it registers queries of its own
