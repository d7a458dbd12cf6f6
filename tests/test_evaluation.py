"""The stored series table spares shuffles; an evaluation without real splits, without temperatures, without readings."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from wattloom.operators import stats
from wattloom.operators.shared import series_table
from wattloom.plans import extracts
from wattloom.plans.evaluate import evaluate

SERIES = ["split", "household_id", "month", "fuel"]


@pytest.fixture(scope="module")
def readings(spark):
    rows = spark.range(6000).select(
        (F.col("id") % 40).alias("household_id"), F.element_at(F.array(*map(F.lit, ("synth", "train", "val", "test"))), (F.col("id") % 4 + 1).cast("int")).alias("split"),
        (F.floor(F.col("id") / 2000) + 1).cast("int").alias("month"), F.when(F.col("id") % 3 == 0, "gas").otherwise("electricity").alias("fuel"), F.col("id").alias("ts"),
        (F.floor(F.col("id") / 40) % 7).cast("int").alias("dow"), (F.floor(F.col("id") / 40) % 48 + 1).cast("int").alias("half_hour"), ((F.col("id") * 7919) % 101).cast("double").alias("value"),
        F.lit(1.0).alias("temp_c"), F.lit("a").alias("segment"),
    )
    return rows.withColumn("value", F.when(F.col("ts") % 11 > 0, F.col("value")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_series_need_no_shuffle(readings):
    table = series_table(readings)
    assert table.count() == readings.count()
    for out in (
        stats.differences(table, SERIES, ["ts"]), stats.autocorrelation(table, SERIES, ["ts"], [1, 2]), stats.rolling_sd(table, SERIES, ["ts"], 3),
        stats.runs(table, F.col("value").isNull(), SERIES, ["ts"]), stats.week_of_series(table, SERIES, ["ts"], length=10),
    ):
        assert "Exchange" not in plan(out) and out.count() > 0
    assert "Exchange" in plan(stats.differences(readings, SERIES, ["ts"]))


def test_lone_synthetic(readings):
    s = evaluate(readings.where("split = 'synth'"), ["segment"], lags=(1,), temp="temp_c")
    flags = s["flags"].collect()
    assert flags and {r["status"] for r in flags} <= {"warn"} and s["verdict"].first()["overall"] == "warn"
    assert extracts.acf(s).where("train is not null").count() == 0
    assert extracts.conditional(s).first()["n_households_train"] == 0


def test_empty_readings(readings):
    s = evaluate(readings.where("false"), ["segment"], lags=(1,))
    assert s["flags"].count() == 0
    assert extracts.seasonal(s).count() == 0 and extracts.volatility(s).count() == 0


def test_small_groups_are_suppressed(readings):
    few = readings.where("household_id < 20").withColumn("segment", F.when(F.col("household_id") < 16, "a").otherwise("b"))
    s = evaluate(few, ["segment"], lags=(1,))
    rows = {(r["fuel"], r["cond_value"]): r for r in extracts.conditional(s).collect()}
    assert rows["gas", "b"]["suppressed"] and rows["gas", "b"]["synth_mean"] is None and rows["gas", "b"]["n_households_synth"] > 0
    hist = extracts.volatility_histogram(stats.differences(few, SERIES, ["ts"]), s)
    assert hist.groupBy("fuel").count().where("count <> 79").count() == 0
    assert hist.where("suppressed and (synth_count is not null or train_density is not null)").count() == 0


def test_suite_goes_on_after_a_failure(readings):
    from wattloom.plans.diagnostics import suite

    edges = {"gas": [0.0, 30.0, 60.0, 1e9], "electricity": [0.0, 10.0, 90.0, 1e9]}

    def keep(name, df):
        if name == "daily_patterns.weekly":
            raise OSError("disk\nfull")
        return df.cache()

    report, tables = suite(readings, ["segment"], edges, length=10, keep=keep)
    rows = report.collect()
    assert {r["diagnostic"]: (r["status"], r["error"]) for r in rows} == {
        "collapse": ("completed", None), "daily_patterns": ("failed", "OSError: disk"), "household_month_fidelity": ("completed", None), "token_distribution": ("completed", None)
    }
    assert not any(k.startswith("daily") for k in tables) and tables["token_distribution.gaps"].count() == 2
    lone, _ = suite(readings.where("split = 'synth'"), [], None, length=10)
    assert {r["diagnostic"] for r in lone.where("status = 'failed'").collect()} == {"token_distribution"}


@pytest.mark.parametrize("rows", [500_000, 0])
def test_quantiles_of_many_groups(spark, rows, monkeypatch):
    import numpy as np

    from wattloom.operators import ranks

    monkeypatch.setattr(ranks, "BROADCAST_ROWS", rows)
    rng = np.random.default_rng(1)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 40, 3000), rng.normal(size=3000))] + [(99, None), (7, None)]
    got = {r["g"]: (r["a"], r["b"]) for r in ranks.quantiles(spark.createDataFrame(data, "g int, v double"), ["g"], "v", {"a": 0.1, "b": 0.9}).collect()}
    for g in range(40):
        assert np.allclose(got[g], np.quantile([v for k, v in data if k == g and v is not None], [0.1, 0.9]))
