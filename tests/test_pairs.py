"""Aggregates of all pairs against plain loops, with blocks so small that groups cross many of them."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from wattloom.operators import features, pairs


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (70, 3)).astype(float)
    x[10], x[11] = x[9], x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows, spark.createDataFrame([*rows, (900, None)], "id long, x array<double>")


def split(vectors, within):
    rows, df = vectors
    if within:
        return pairs.Pairs(df, block_rows=16), [(i, j, math.dist(a, b)) for i, a in rows for j, b in rows if i < j]
    one, two = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3]
    p = pairs.Pairs(df.where("id % 3 = 0"), df.where("id % 3 > 0"), block_rows=16)
    return p, [(i, j, math.dist(a, b)) for i, a in one for j, b in two]


@pytest.mark.parametrize("within", [True, False])
def test_summary(vectors, within):
    p, want = split(vectors, within)
    d, got = np.array([x[2] for x in want]), p.summary().first()
    q = np.quantile(d, [0.25, 0.5, 0.75])
    assert got["n"] == len(d)
    assert np.allclose([got[c] for c in ("mean", "sd", "least", "q25", "median", "q75", "most", "iqr")], [d.mean(), d.std(), d.min(), *q, d.max(), q[2] - q[0]])


@pytest.mark.parametrize("within", [True, False])
@pytest.mark.parametrize("most", [40, 10_000])
def test_sample(vectors, within, most):
    p, want = split(vectors, within)
    bits = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:16], 16)
    h = lambda a, b: (bits(a) * pairs.FACTORS[0] + bits(b) * pairs.FACTORS[1]) % 2**64 >> 1
    ordered = [(a, b, d) if not within or bits(a) < bits(b) else (b, a, d) for a, b, d in want]
    chosen = sorted(ordered, key=lambda r: (h(r[0], r[1]), r[0], r[1]))[:most]
    got = [(r["a"], r["b"], r["distance"]) for r in p.sample(most).collect()]
    assert sorted(x[:2] for x in got) == sorted(x[:2] for x in chosen)
    assert np.allclose(sorted(x[2] for x in got), sorted(x[2] for x in chosen))


def test_row_stats_and_outliers(vectors, monkeypatch):
    monkeypatch.setattr(pairs, "MARKS", 7)  # several parts of marks
    p, want = split(vectors, False)
    values = np.array([x[2] for x in want])
    means = {i: np.mean([d for a, _, d in want if a == i]) for i in {a for a, _, _ in want}}
    stats = {r["id"]: r for r in p.row_stats().collect()}
    assert all(math.isclose(stats[i]["mean"], m) and math.isclose(stats[i]["least"], min(d for a, _, d in want if a == i)) for i, m in means.items())
    got = {r["id"]: r for r in features.outliers(p).collect()}
    assert set(got) == set(means)
    for i, r in got.items():
        assert math.isclose(r["percentile"], 100 * (values < r["mean"]).mean()) and r["outlier"] == (r["mean"] > np.quantile(values, 0.95))


def test_empty_sides(vectors):
    _, df = vectors
    p = pairs.Pairs(df, df.where("false"))
    assert p.summary().first()["n"] == 0 and p.quantiles({"a": 0.5}).first()["a"] is None
    assert p.sample(5).count() == 0 and p.row_stats().count() == 0


def test_batches(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SERIES_ROWS", 4)
    rng = np.random.default_rng(1)
    rows = [(b, h, s, float(rng.integers(0, 5))) for b in range(3) for h in range(9) for s in range(12) if rng.random() < 0.8]
    rows += [(0, 50, s, 2.0) for s in range(12)] + [(1, 51, s, v) for b, h, s, v in rows if (b, h) == (1, 3)] + [(2, 52, 99, None), (3, 1, 0, 1.0)]
    df = spark.createDataFrame(rows, "batch_id long, household_id long, step long, value double")
    series = {}
    for b, h, s, v in rows:
        series.setdefault(b, {}).setdefault(h, {})[s] = v or 0.0
    want_r, want_d = {}, {}
    for b, homes in series.items():
        for i in homes:
            for j in homes:
                steps = [s for s in homes[i] if s in homes[j]]
                if i < j and steps:
                    x, y = (np.array([homes[k][s] for s in steps]) for k in (i, j))
                    if all(np.ptp(list(homes[k].values())) > 0 for k in (i, j)):
                        want_r.setdefault(b, []).append(np.corrcoef(x, y)[0, 1] if np.ptp(x) and np.ptp(y) else np.nan)
                    scale = [np.mean(np.abs(list(homes[k].values()))) or np.inf for k in (i, j)]
                    want_d.setdefault(b, []).append(np.sqrt(((x / scale[0] - y / scale[1]) ** 2).sum()))
    got = {r["batch_id"]: r for r in pairs.batch_correlations(df, ["batch_id"]).collect()}
    assert set(got) == set(want_r)
    for b, r in want_r.items():
        r = np.array([v for v in r if not np.isnan(v)])
        assert got[b]["pairs"] == len(r) and got[b]["high_pairs"] == (r > 0.95).sum()
        assert np.allclose([got[b]["mean_corr"], got[b]["max_corr"]], [r.mean(), r.max()])
    got = {r["batch_id"]: r for r in pairs.batch_distances(df, ["batch_id"]).collect()}
    assert set(got) == set(want_d)
    for b, d in want_d.items():
        assert np.allclose([got[b]["mean_distance"], got[b]["least_distance"]], [np.mean(d), min(d)], atol=1e-9) and got[b]["near_identical"] == (d < 0.01 * np.mean(d)).sum()


def test_rows_move_a_fixed_number_of_times(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCKS", 3)
    df = spark.range(400).selectExpr("id", "array(double(id % 7), double(id % 11)) AS x")
    for p, copies in ((pairs.Pairs(df, df, block_rows=8), 3), (pairs.Pairs(df, block_rows=8), 2)):  # within a group: with itself and half the others
        moved = p.fold(lambda meet: pairs.pa.table([[meet.a.num_rows]], ["n"]), "n long").groupBy().sum("n").first()[0]
        assert moved <= 1.2 * copies * 400


@pytest.mark.parametrize("within", [True, False])
def test_ranges_are_cut_until_few_values_are_left(vectors, within, monkeypatch):
    monkeypatch.setattr(pairs, "VALUES", 5)  # many distances tie, so every level is needed
    p, want = split(vectors, within)
    d, shares = np.array([x[2] for x in want]), {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    assert np.allclose(list(p.quantiles(shares).first()), np.quantile(d, list(shares.values())))


def test_copies_are_at_distance_zero(spark):
    p = pairs.Pairs(spark.range(300).selectExpr("id", "array(0.1D, 0.7D, 1e5D) AS x"), block_rows=100)
    assert list(p.summary().first()) == [300 * 299 // 2] + [0.0] * 8
