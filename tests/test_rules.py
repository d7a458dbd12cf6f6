"""Hand-computed cases for the rules of the meter operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from wattloom.functions.scalars import adjusted_kurtosis, adjusted_skew, safe_corr
from wattloom.operators import compare, features, filters, generate, grade, privacy, sequences, splits, stats, vocab
from wattloom.plans import evaluate
from wattloom.schema import nan_to_null
from wattloom.sources import fixtures, readers, writers


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def column(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_encode_standard(spark):
    df = spark.createDataFrame([(50.0,), (150.0,), (250.0,), (None,), (100.0,), (float("nan"),)], "v double")
    assert [r[0] for r in df.select(vocab.encode(F.col("v"), arr(100, 200, 300))).collect()] == [0, 1, 2, 4, 0, 4]
    assert {k: column(spark, c) for k, c in vocab.layout(arr(1, 2, 3)).items()} == {"bins": 4, "missing": 4, "sos": 5, "size": 6}


def test_encode_zero_aware(spark):
    df = spark.createDataFrame([(0.0,), (0.04,), (50.0,), (150.0,), (250.0,), (None,)], "v double")
    assert [r[0] for r in df.select(vocab.encode(F.col("v"), arr(100, 200), True)).collect()] == [0, 0, 1, 2, 3, 4]


def test_round_trip(spark):
    df = spark.createDataFrame([(float(i), ) for i in range(0, 400, 7)], "v double")
    token = vocab.encode(F.col("v"), arr(100, 200, 300))
    back = vocab.encode(vocab.decode(token, arr(100, 200, 300)), arr(100, 200, 300))
    assert df.where((token != back) & ~token.isin(0, 3)).count() == 0 and df.where(vocab.decode(F.lit(4), arr(100, 200, 300)).isNotNull()).count() == 0


def test_runs_and_correlation(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([0, 0, 1, 0, 0, 0, 2])], "h int, t int, v int")
    got = stats.run_histogram(stats.runs(df, F.col("v") == 0, ["h"], ["t"])).collect()
    assert sorted((r["length"], r["runs"]) for r in got) == [(2, 1), (3, 1)]
    pairs = spark.createDataFrame([(float(i), float(2 * i)) for i in range(10)], "x double, y double")
    assert abs(pairs.agg(safe_corr("x", "y").alias("r")).first()["r"] - 1) < 1e-12
    assert pairs.limit(9).agg(safe_corr("x", "y").alias("r")).first()["r"] is None
    assert pairs.withColumn("y", F.lit(1.0)).agg(safe_corr("x", "y").alias("r")).first()["r"] is None


def test_moments(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 4.0, 9.0, 20.0)], "x double")
    r = df.agg(adjusted_skew(F.col("x")).alias("s"), adjusted_kurtosis(F.col("x")).alias("k")).first()
    assert abs(r["s"] - 1.49012) < 1e-4 and abs(r["k"] - 1.89543) < 1e-4


def test_entropy_and_disclosure(spark):
    df = spark.createDataFrame([(0,), (0,), (1,), (1,)], "t int")
    assert compare.token_summary(compare.token_counts(df, F.col("t"), 2), 2).first()["entropy"] == 1.0
    counts = spark.createDataFrame([(n,) for n in (5, 15, 25, 34, 36, None)], "n int")
    assert [r[0] for r in counts.select(privacy.round_ten(F.col("n"))).collect()] == [0, 20, 20, 30, 40, None]
    cells = spark.createDataFrame([("a", "x", 5, 1.0), ("a", "y", 50, 2.0), ("b", "x", 14, 3.0)], "g string, f string, n int, m double")
    got = {(r["g"], r["f"]): (r["n"], r["m"], r["suppressed"]) for r in privacy.suppressed(cells, ["g"], ["n"], ["m"]).collect()}
    assert got == {("a", "x"): (None, None, True), ("a", "y"): (None, None, True), ("b", "x"): (10, 3.0, False)}


def test_identical_samples(spark):
    a = spark.createDataFrame([(float(i % 7),) for i in range(50)], "value double")
    r = compare.distances(a, a).first()
    assert r["wasserstein"] == 0 and r["ks"] == 0
    assert a.select(compare.ks_p(F.lit(0.0), F.lit(50), F.lit(50)).alias("p")).first()["p"] == 1.0
    assert abs(compare.student_p(2.262157, 9) - 0.05) < 1e-5


def test_nan(spark):
    assert nan_to_null(spark.createDataFrame([(float("nan"), 1)], "a double, b int")).first()["a"] is None


def test_grades(spark):
    df = spark.createDataFrame([(0.05, 0.1), (0.2, 0.1), (0.5, 0.1), (0.1, None)], "v double, nv double")
    assert [r[0] for r in df.select(grade.nv_status(F.col("v"), F.col("nv"))).collect()] == ["pass", "warn", "fail", "warn"]


def test_splits(spark):
    homes = spark.range(100).select(F.col("id").alias("household_id"))
    a = {r["household_id"]: r["split"] for r in splits.assign_splits(homes, 10, 20).collect()}
    b = {r["household_id"]: r["split"] for r in splits.assign_splits(homes.repartition(7), 10, 20).collect()}
    assert a == b and sorted(a.values()).count("val") == 10 and sorted(a.values()).count("test") == 20
    with pytest.raises(ValueError):
        splits.assign_splits(homes, 50, 50)
    assert splits.sample_rows(homes, 250, "household_id").count() == 250


def test_k_anonymity(spark):
    df = spark.createDataFrame([(i, "a" if i < 5 else "b", None if i == 0 else "z") for i in range(7)], "household_id long, u string, w string")
    assert {(r["u"], r["size"], r["qualifies"]) for r in privacy.k_groups(df, ["u", "w"], 3).collect()} == {("a", 4, True), ("b", 2, False)}
    with pytest.raises(ValueError):
        privacy.assert_k(df, ["u"], 3)
    masked = privacy.masked_contexts(df, ["u"], ["w"], 3)
    assert masked.agg(F.min("group_size")).first()[0] >= 3
    assert privacy.best_contexts(masked).groupBy("household_id").count().where("count > 1").count() == 0


def test_stage_report(spark):
    df = spark.range(10)
    got = filters.stage_report(df, {"even": F.col("id") % 2 == 0, "small": F.col("id") < 5}).collect()
    assert [(r["stage"], r["n"], r["removed"]) for r in got] == [("even", 5, 5), ("small", 3, 2)]


def test_windows_and_generation(spark):
    df = spark.createDataFrame([(1, i, i % 4, 1 + i // 40, i % 7) for i in range(120)], "household_id int, ts int, token int, month int, dow int")
    got = sequences.month_windows(df, 10, ["token", "dow"], ["token"], {"token": 9}).collect()
    assert len(got) == 3
    for r in got:
        assert len(r["x"]) == 10 and r["x"][0][0] == 9 and [x[0] for x in r["x"][1:]] == [y[0] for y in r["y"][:-1]]
    model = generate.joint_transitions(df.withColumn("elec", F.col("token")).withColumn("gas", F.col("dow")), [], [], ["household_id"])
    steps = spark.range(2).select(F.col("id").alias("sample_id"), F.lit(1).alias("month"), F.explode(F.sequence(F.lit(0), F.lit(50))).alias("pos"))
    a, b = (sorted(map(tuple, generate.generate(steps, model, [], [], {"elec": 4, "gas": 7}, temperature=0.2).collect())) for _ in range(2))
    assert a == b and len(a) == 102 and all(0 <= r[3] < 4 and 0 <= r[4] < 7 for r in a)
    losses = spark.createDataFrame([(i, x) for i, x in enumerate([3.0, 2.0, 2.5, 2.0, 2.4])], "epoch int, loss double")
    assert [r["epoch"] for r in sequences.best_epoch(losses, 3).where("is_best").collect()] == [1]


def test_fixture_year(spark):
    ids = fixtures.household_ids(spark, 3)
    year = fixtures.readings(ids)
    assert year.count() == 3 * 17520 and ids.distinct().count() == 3
    r = year.agg(F.min("ts"), F.max("ts"), F.min("half_hour"), F.max("half_hour"), F.min("gas")).first()
    assert str(r[0]) == "2023-01-01 00:30:00" and str(r[1]) == "2024-01-01 00:00:00" and (r[2], r[3]) == (1, 48) and r[4] >= 0


def test_files(spark, tmp_path):
    ids = fixtures.household_ids(spark, 30)
    tables = {"survey": fixtures.survey(ids), "epc": fixtures.epc(ids), "participant": fixtures.participants(ids), "follow_up": fixtures.follow_up(ids), "exporters": fixtures.exporters(ids)}
    for name, df in tables.items():
        writers.write_csv(df, f"{tmp_path}/{name}")
    got = readers.join_metadata(tables["survey"], tables["epc"], tables["participant"], tables["follow_up"], readers.exporter_ids(spark, f"{tmp_path}/exporters"))
    assert got.count() == 30 and "C1_fu" in got.columns
    rows = fixtures.readings(ids.limit(1)).select(F.col("PUPRN").alias("household_id"), F.lit("train").alias("split"), "ts", F.col("electricity").alias("value"))
    writers.write_tokens(rows, f"{tmp_path}/tokens")
    assert readers.readings(spark, f"{tmp_path}/tokens", split="train").count() == 17520


def test_evaluation_of_generated_data(spark):
    ids = fixtures.household_ids(spark, 8)
    long = fixtures.readings(ids).where("month(ts) <= 2").select(
        F.col("PUPRN").alias("household_id"), F.element_at(F.array(*[F.lit(s) for s in ("synth", "train", "val", "test")]), (F.pmod(F.hash("PUPRN"), F.lit(4)) + 1)).alias("split"), "ts",
        F.month("ts").alias("month"), F.weekday("ts").alias("dow"), "half_hour", F.lit("electricity").alias("fuel"), F.col("electricity").alias("value"),
    )
    s = evaluate.evaluate(long, [])
    assert s["flags"].count() >= 8 and s["verdict"].first()["overall"] in ("pass", "warn", "fail")
    assert not {"features", "runs"} & set(evaluate.sanitised(s))
    assert s["acf"].where("abs(mean) > 1").count() == 0


def test_stream(spark, tmp_path):
    from wattloom.streaming.half_hours import resample, start

    rows = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-01 06:00:00', INTERVAL 10 MINUTES)) AS ts").select("ts", F.lit(1).alias("household_id"), F.lit("gas").alias("fuel"), F.lit(2.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    start(resample(stream), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    got, whole = spark.read.parquet(f"{tmp_path}/out"), resample(rows)
    assert 0 < got.count() <= whole.count() and got.join(whole, ["household_id", "fuel", "start", "total", "n"]).count() == got.count()


def test_masking_lattice(spark):
    """Every prefix's group, counted plainly; the lattice drops what is under k with all that shows more."""
    import random

    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), *[rng.choice(["x", "y", "z", None] if v == 2 else ["x", "y"]) for v in range(4)]) for i in range(120)]
    df = spark.createDataFrame(rows, "household_id long, r string, p string, q string, s string, t string")
    got = privacy.masked_contexts(df, ["r"], ["p", "q", "s", "t"], 9, augmentations=3).collect()
    known = [dict(zip(df.columns, r)) for r in rows if None not in r]
    assert {r["household_id"] for r in got} <= {r["household_id"] for r in known}
    by = {}
    for r in got:
        assert r["variables"][0] == "r" and len(r["variables"]) == r["var_count"]
        same = sum(all(x[v] == w for v, w in zip(r["variables"], r["values"])) for x in known)
        assert r["group_size"] == same >= 9
        by.setdefault((r["household_id"], r["augmentation"]), {})[r["var_count"]] = r["variables"]
    for (i, _), levels in by.items():
        own = next(x for x in known if x["household_id"] == i)
        longest = levels[max(levels)]
        assert sorted(levels) == list(range(1, len(longest) + 1)) and all(v == longest[:n] for n, v in levels.items())
        if len(longest) < 5:  # no variable that could come next is skipped silently: its group is too small for some
            assert any(sum(all(x[v] == own[v] for v in [*longest, nxt]) for x in known) < 9 for nxt in "pqst" if nxt not in longest)


def test_hash_ranks(spark):
    df = spark.range(1000).select(F.col("id").alias("household_id"), (F.col("id") % 3).alias("g")).union(spark.createDataFrame([(5, 2), (5, 2)], "household_id long, g long"))
    got = splits.hash_rank(df, ["g"], ["household_id"], rows=20).collect()
    for g in range(3):
        own = sorted((r["_r"] for r in got if r["g"] == g))
        assert own == list(range(len(own)))
    same = {(r["household_id"], r["_r"]) for r in got}
    assert same == {(r["household_id"], r["_r"]) for r in splits.hash_rank(df.repartition(5), ["g"], ["household_id"]).collect()}


def test_sample_each(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4990, "big").otherwise(None).alias("g"), F.lit(7).alias("same"))
    got = splits.sample_each(df, 20, ["g"], ["id"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"big": 20, None: 10}
    assert splits.sample_each(df, 20, ["g"], ["same"]).count() == 30  # every row has one hash
    assert splits.sample_each(df.where("false"), 20, ["g"], ["id"]).count() == 0


def test_masking_is_dealt_over_tasks(spark):
    df = spark.range(500).coalesce(1).selectExpr("id AS household_id", "'x' AS r", "string(id % 2) AS p", "string(id % 3) AS q")
    masked = privacy.masked_contexts(df, ["r"], ["p", "q"], 3)
    assert masked.where("var_count = 3").count() == 500
    assert len({r[0] for r in masked.where("var_count = 2").select(F.input_file_name()).distinct().collect()}) > 1  # one task's file before
