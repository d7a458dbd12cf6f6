"""Two-fuel generation against a plain walk, and training over shards against losses worked out epoch by epoch."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from wattloom.operators import generate, training

BINS = {"elec": 5, "gas": 4}


@pytest.fixture(scope="module")
def tokens(spark):
    import random

    rng = random.Random(6)
    # 5 and 4 are the special tokens of the fuels: they occur in the data and are never drawn
    rows = [(h, h % 2, t % 3, t, rng.choice([0, 1, 2, 3, 4, 5]), rng.choice([0, 1, 2, 3, 4, None])) for h in range(12) for t in range(40)]
    return rows, spark.createDataFrame(rows, "household_id long, kind int, slot int, ts long, elec int, gas int")


def counted(rows):
    out = Counter()
    for h in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == h), key=lambda r: r[3])
        for a, b in zip(own, own[1:]):
            if None not in (a[4], a[5], b[4], b[5]):
                for fuel, nxt in (("elec", b[4]), ("gas", b[5])):
                    out[b[1], b[2], fuel, a[4], a[5], nxt] += 1
    return out


@pytest.mark.parametrize("part, temperature", [(500, 1.0), (2, 0.5)])
def test_generation(spark, tokens, part, temperature):
    rows, df = tokens
    model = generate.joint_transitions(df, ["kind"], ["slot"], ["household_id"])
    counts = counted(rows)
    assert {tuple(r)[:6]: r["n"] for r in model.collect()} == dict(counts)
    steps = [(s, m, p, kind, p % 3, "x") for s in ("a", "b", "c") for m in (1, 2) for kind in [(len(s) + m) % 2 if s != "c" else 9] for p in range(30)]
    got = generate.generate(spark.createDataFrame(steps, "sample_id string, month int, pos int, kind int, slot int, _x string"), model, ["kind"], ["slot"], BINS, {"elec": 5, "gas": 4}, temperature, part=part)
    made = {(r["sample_id"], r["month"], r["pos"]): (r["elec"], r["gas"]) for r in got.collect()}
    assert set(got.columns) == {"sample_id", "month", "pos", "kind", "slot", "_x", "elec", "gas"} and len(made) == len(steps)

    def cdf(kind, slot, fuel, last):
        own = last[0] if fuel == "elec" else last[1]
        for test in (lambda e, g: (e, g) == last, lambda e, g: (e if fuel == "elec" else g) == own, lambda e, g: True):
            n = Counter()
            for (k, s, f, e, g, nxt), c in counts.items():
                if (k, s, f) == (kind, slot, fuel) and test(e, g) and nxt < BINS[fuel]:
                    n[nxt] += c
            if n:
                w = [n[t] ** (1 / temperature) if n[t] else 0.0 for t in range(BINS[fuel])]
                return [sum(w[: t + 1]) / sum(w) for t in range(BINS[fuel])]
        return [(t + 1) / BINS[fuel] for t in range(BINS[fuel])]

    for sample in ("a", "b", "c"):
        for month in (1, 2):
            last = (5, 4)
            for s, m, p, kind, slot, _ in (x for x in steps if x[:2] == (sample, month)):
                last = tuple(next((t for t, c in enumerate(cdf(kind, slot, f, last)) if c > generate.draw(s, m, p, f, 42)), BINS[f] - 1) for f in generate.FUELS)
                assert made[s, m, p] == last
    assert all(e < 5 and g < 4 for e, g in made.values())


def test_run_summary(spark, tokens):
    _, df = tokens
    model = generate.joint_transitions(df, [], [], ["household_id"])
    steps = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (1, 2, 0), (2, 1, 0)], "sample_id int, month int, pos int")
    series = generate.generate(steps, model, [], [], BINS)
    means = spark.createDataFrame([(f, t, t * 10.0) for f in generate.FUELS for t in range(5)], "fuel string, token int, value double")
    values = generate.values_of(series, means)
    assert values.count() == 8 and values.where("value <> token * 10").count() == 0
    asked = spark.createDataFrame([(1,), (2,), (3,)], "sample_id int")
    got = {r["sample_id"]: (r["months"], r["steps"], r["failed"]) for r in generate.run_summary(series, asked).collect()}
    assert got == {1: (2, 3, False), 2: (1, 1, False), 3: (0, 0, True)}
    assert generate.generate(steps.where("false"), model, [], [], BINS).count() == 0


def test_training(spark):
    import random

    rng = random.Random(4)
    train = [(s, rng.randrange(2), rng.randrange(3), rng.randrange(3), rng.randrange(1, 9)) for s in range(4) for _ in range(12)]
    held = [(rng.randrange(3), rng.randrange(3), rng.randrange(3), rng.randrange(1, 5)) for _ in range(9)]
    counts = spark.createDataFrame(train, "shard int, c int, prev int, next int, n int")
    history = {r["epoch"]: r for r in training.losses(counts, spark.createDataFrame(held, "c int, prev int, next int, n int"), ["c"], 3).collect()}
    order = [r["shard"] for r in sorted(training.shard_order(counts).collect(), key=lambda r: r["epoch"])]
    want = {}
    for epoch in range(1, 5):
        seen = [r for r in train if r[0] in order[:epoch]]
        of = lambda test: sum(r[4] for r in seen if test(*r[1:4]))
        total = 0.0
        for c, a, b, k in held:
            base = (of(lambda x, p, q: (p, q) == (a, b)) + 2 / 3) / (of(lambda x, p, q: p == a) + 2)
            total -= k * math.log((of(lambda x, p, q: (x, p, q) == (c, a, b)) + 2 * base) / (of(lambda x, p, q: (x, p) == (c, a)) + 2))
        want[epoch] = total / sum(x[3] for x in held)
        assert math.isclose(history[epoch]["loss"], want[epoch]) and history[epoch]["n_train"] == sum(r[4] for r in seen) and history[epoch]["shard"] == order[epoch - 1]
    model, told = training.train(counts, spark.createDataFrame(held, "c int, prev int, next int, n int"), ["c"], 3, patience=1)
    rows = sorted(told.collect(), key=lambda r: r["epoch"])
    stop = next((e for e in range(2, 5) if want[e] >= min(want[x] for x in range(1, e))), 4)
    assert [r["epoch"] for r in rows] == list(range(1, stop + 1))
    best = min(range(1, stop + 1), key=lambda e: (want[e], e))
    assert [r["epoch"] for r in rows if r["is_best"]] == [best]
    assert model.agg({"n": "sum"}).first()[0] == sum(r[4] for r in train if r[0] in order[:best])


def test_whole_run(spark, tokens, tmp_path):
    from wattloom.plans import synthesis

    _, df = tokens
    df = df.withColumn("month", (df["ts"] / 20).cast("int") + 1)
    means = spark.createDataFrame([(f, t, t * 10.0) for f in generate.FUELS for t in range(5)], "fuel string, token int, value double")
    pool = df.select("household_id").distinct().where("household_id < 5")
    made = synthesis.run(pool, df, df.where("household_id > 8").select("household_id", "month", "ts", "kind", "slot"), means, 12, BINS, ["kind"], ["slot"])
    samples = made["samples"].collect()
    assert len({r["sample_id"] for r in samples}) == 12 and {r["template_id"] for r in samples} <= {9, 10, 11}
    assert made["series"].count() == 12 * 40 and made["summary"].where("failed or months <> 2 or steps <> 40").count() == 0
    assert made["series"].where("elec > 4 or gas > 3").count() == 0
    synthesis.write(made, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run" / "values")).count() == 12 * 40 * 2
    assert synthesis.run(pool.where("false"), df, df.select("household_id", "month", "ts", "kind", "slot"), means, 12, BINS, ["kind"], ["slot"])["series"].count() == 0


def test_vocabulary_edges_and_tuples(spark):
    from wattloom.sources import readers

    vocab = spark.createDataFrame([("gas", [1.0, 2.0]), ("electricity", None)], "modality string, boundaries array<double>")
    assert readers.bin_edges(vocab) == {"gas": [-math.inf, 1.0, 2.0, math.inf]} and readers.bin_edges(None) is None and readers.bin_edges(vocab.drop("boundaries")) is None
    survey = spark.createDataFrame([("a", 3, None), ("b", None, 2)], "PUPRN string, B5 int, C1_new int")
    assert {tuple(r) for r in readers.context_tuples(survey).collect()} == {("a", 3, 0), ("b", 0, 2)}
    assert [tuple(r) for r in readers.survey_row(survey, "b", ["B5"]).collect()] == [("b", None)]
